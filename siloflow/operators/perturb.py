"""Rewriting labelled notes in other formats with exact new spans, to test how robust a detector is.

A transform makes edits (start, end, text, label or null) from a note and its spans; ``apply`` carries
them out and moves the spans along. Choices are made by hashes of the seed and the text, so that they are the
same wherever a row is processed. All of it is array expressions within the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.functions import spans as S
from siloflow.functions.regex import cut_out, found

EDIT = "array<struct<start:int,end:int,text:string,label:string>>"
# Month names, replacement stocks and cue rewrites.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
PHONES_DE = ("(030) 1234 5678", "030/12345678", "+49-30-1234-5678", "+49 (0)30 12345678")
PHONES_IN = ("98765 43210", "+91-98765-43210", "044 2345 6789", "+91 (44) 2345 6789")
GIVEN = ("Anna-Lena", "Jean-Luc", "Maria José", "Sri Lakshmi", "Karl-Heinz", "Ana Sofia")
FAMILY = ("Schmidt-Weber", "O'Connor", "Venkataraman", "Müller-Lüdenscheidt", "Da Silva", "Reddy-Rao")
CUES = (
    ("DOB: ", "Date of birth: "), (r"\(DOB ", "(D.O.B. "), ("born ", "date of birth "), ("Encounter date: ", "Admitted on: "),
    ("Admission: ", "Date of admission: "), ("Visit: ", "Date of visit: "), ("DOA ", "Admitted "), ("seen ", "visit "),
    ("Telephone: ", "Tel.: "), ("Mobile: ", "Mobile no.: "), ("; ph ", "; phone "), ("Case ID: ", "Patient ID: "),
    ("MRN: ", "Hospital No.: "), ("Patient: ", "Patient name: "), ("Name: ", "Patient name: "),
    (r"Attending physician: Dr\. ", "Attending: Dr. med. "), ("Treating clinician: ", "Seen by: "),
    ("Consultant: Dr ", "Consultant in charge: Dr. "), ("Address: ", "Home address: "), ("Residence: ", "Address: "),
)
COMBINED = ("ids_alternative_schemes", "phones_national_formats", "names_complex", "cues_relabelled", "layout_single_line", "dates_iso")


def _edit(s: Column, text: Column, label: Column | None = None) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), text.alias("text"), (F.lit(None).cast("string") if label is None else label).alias("label"))


def _picked(stock: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, stock)), (F.pmod(h, F.lit(len(stock))) + 1).cast("int"))


def _chance(seed: int, salt: str, *what: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *what)


def parsed_date(text: Column) -> Column:
    """struct<d,m,y> of d.m.yyyy (or with - or /) and d-Mon-yyyy, else null."""
    by_number = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    by_name = r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$"
    part = lambda p, i: F.regexp_extract(text, p, i)
    short = F.array(*(F.lit(m[:3]) for m in MONTHS))
    month = F.array_position(short, F.initcap(part(by_name, 2)))
    made = lambda p, m: F.struct(part(p, 1).cast("int").alias("d"), m.cast("int").alias("m"), part(p, 3).cast("int").alias("y"))
    return F.when(text.rlike(by_number), made(by_number, part(by_number, 2))).when(text.rlike(by_name) & (month > 0), made(by_name, month))


def _two(n: Column, width: int = 2) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _month_name(m: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), m - 1)


DATE_STYLES = {
    "dates_iso": lambda p: F.concat_ws("-", _two(p["y"], 4), _two(p["m"]), _two(p["d"])),
    "dates_long": lambda p: F.concat_ws(" ", p["d"], _month_name(p["m"]), p["y"]),
    "dates_us_long": lambda p: F.concat(_month_name(p["m"]), F.lit(" "), p["d"].cast("string"), F.lit(", "), p["y"].cast("string")),
    "dates_two_digit_year": lambda p: F.concat_ws(".", _two(p["d"]), _two(p["m"]), _two(F.pmod(p["y"], F.lit(100)))),
}


def _of_label(note: Column, spans: Column, labels: tuple[str, ...], text) -> Column:
    """An edit for each span of some labels for which ``text(original)`` is not null."""
    edits = F.transform(F.filter(spans, lambda s: s["label"].isin(*labels)), lambda s: _edit(s, text(cut_out(note, s["start"], s["end"])), s["label"]))
    return F.filter(edits, lambda e: e["text"].isNotNull())


def _dates(style):
    def edits(note: Column, spans: Column, seed: int) -> Column:
        def text(said: Column) -> Column:
            p = parsed_date(said)
            return F.when(p.isNotNull() & p["m"].between(1, 12), style(p))

        return _of_label(note, spans, ("DATE_OF_BIRTH", "ENCOUNTER_DATE"), text)

    return edits


def _ids(note: Column, spans: Column, seed: int) -> Column:
    def text(said: Column) -> Column:
        n = lambda salt, low, high: (F.pmod(_chance(seed, salt, said), F.lit(high - low + 1)) + low).cast("string")
        style = F.pmod(_chance(seed, "style", said), F.lit(3))
        ber = F.concat(F.lit("BER/"), n("a", 2019, 2026), F.lit("/"), n("b", 10, 99))
        uhid = F.concat(F.lit("UHID/"), n("c", 10000, 99999), F.lit("/"), n("d", 10, 99))
        mrn = F.concat(F.lit("MRN-"), n("e", 10, 99), F.lit("-"), n("f", 10000, 99999))
        return F.when(style == 0, ber).when(style == 1, uhid).otherwise(mrn)

    return _of_label(note, spans, ("PATIENT_ID",), text)


def _phones(note: Column, spans: Column, seed: int) -> Column:
    text = lambda said: F.when(said.startswith("+49"), _picked(PHONES_DE, _chance(seed, "de", said))).otherwise(_picked(PHONES_IN, _chance(seed, "in", said)))
    return _of_label(note, spans, ("PHONE_NUMBER",), text)


def _names(note: Column, spans: Column, seed: int) -> Column:
    """The same original gets the same replacement."""
    text = lambda said: F.concat(_picked(GIVEN, _chance(seed, "given", said)), F.lit(" "), _picked(FAMILY, _chance(seed, "family", said)))
    return _of_label(note, spans, ("PATIENT_NAME", "CLINICIAN_NAME"), text)


def _inverted(note: Column, spans: Column, seed: int) -> Column:
    def text(said: Column) -> Column:
        given, family = F.substring_index(said, " ", 1), F.regexp_replace(said, r"^\S* ?", "")
        loud = F.pmod(_chance(seed, "inverted", said), F.lit(2)) == 0
        return F.concat(F.when(loud, F.upper(family)).otherwise(family), F.lit(", "), given)

    return _of_label(note, spans, ("PATIENT_NAME",), text)


def _cues(note: Column, spans: Column, seed: int) -> Column:
    """Earlier rules go first; no rewrite touches a span or another rewrite."""

    def rewrites(pattern: str, text: str) -> Column:
        return F.transform(found(note, pattern), lambda m: _edit(m, F.lit(text)))

    out = F.array().cast(EDIT)
    for pattern, text in CUES:
        out = F.aggregate(rewrites(pattern, text), out, lambda acc, e: F.when(F.exists(acc, lambda x: S.overlap(x, e)) | F.exists(spans, lambda x: S.overlap(x, e)), acc).otherwise(F.concat(acc, F.array(e))))
    return out


def _single_line(note: Column, spans: Column, seed: int) -> Column:
    return F.transform(found(note, "\\n"), lambda m: _edit(m, F.lit(" | ")))


TRANSFORMS = {
    **{name: _dates(style) for name, style in DATE_STYLES.items()},
    "ids_alternative_schemes": _ids,
    "phones_national_formats": _phones,
    "names_complex": _names,
    "names_inverted": _inverted,
    "cues_relabelled": _cues,
    "layout_single_line": _single_line,
}


def apply(rows: DataFrame, note: str, spans: str, edits: Column) -> DataFrame:
    """Carry out edits that do not overlap (else the row fails); unedited spans move along, edited ones take the edit's label and length."""
    typed = F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].alias("text"), e["label"].alias("label")))
    out = rows.withColumn("_e", F.array_sort(typed))
    old = F.col(note)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int,shift:int,len:int,label:string>>").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        bad = F.raise_error(F.lit("edits overlap")).cast("string")
        kept = F.when(e["start"] < acc["at"], bad).otherwise(cut_out(old, acc["at"], e["start"]))
        before = F.concat(acc["text"], kept)
        made = F.struct(e["start"].alias("start"), e["end"].alias("end"), (F.length(before) - e["start"]).alias("shift"), F.length(e["text"]).alias("len"), e["label"].alias("label"))
        return F.struct(e["end"].alias("at"), F.concat(before, e["text"]).alias("text"), F.concat(acc["done"], F.array(made)).alias("done"))

    out = out.withColumn("_a", F.aggregate("_e", begin, step))
    done = F.col("_a.done")
    replaced = lambda s: F.exists(done, lambda d: d["label"].isNotNull() & (d["start"] == s["start"]) & (d["end"] == s["end"]))
    shift = lambda s: F.aggregate(done, F.lit(0), lambda acc, d: F.when(d["end"] <= s["start"], d["shift"] + d["len"] - (d["end"] - d["start"])).otherwise(acc))
    moved = F.transform(F.filter(spans, lambda s: ~replaced(s)), lambda s: S.span(s["start"] + shift(s), s["end"] + shift(s), s["label"], "moved"))
    new = F.transform(F.filter(done, lambda d: d["label"].isNotNull()), lambda d: S.span(d["start"] + d["shift"], d["start"] + d["shift"] + d["len"], d["label"], "edited"))
    text = F.concat(F.col("_a.text"), F.substring(old, F.col("_a.at") + 1, F.length(old)))
    out = out.withColumn("_s", F.array_sort(F.concat(moved, new))).withColumn("_t", text)
    return out.withColumns({note: F.col("_t"), spans: F.col("_s")}).drop("_e", "_a", "_s", "_t")


def perturb(rows: DataFrame, note: str, spans: str, transform: str, seed: int = 0) -> DataFrame:
    """One transform by name, or ``combined``: several, each on what the last one made."""
    rows = rows.withColumn(spans, F.col(spans).cast(S.SPANS))
    names = COMBINED if transform == "combined" else (transform,)
    return reduce(lambda out, name: apply(out, note, spans, TRANSFORMS[name](F.col(note), F.col(spans), seed)), names, rows)


def every_transform(rows: DataFrame, note: str, spans: str, seed: int = 0) -> DataFrame:
    """All transforms of all rows, with the column transform; ``identity`` leaves them alone."""
    parts = [rows.withColumn(spans, F.col(spans).cast(S.SPANS)).withColumn("transform", F.lit("identity"))]
    parts += [perturb(rows, note, spans, name, seed).withColumn("transform", F.lit(name)) for name in (*TRANSFORMS, "combined")]
    return reduce(DataFrame.unionByName, parts)


def evaluate_transforms(moved: DataFrame, note: str, spans: str) -> DataFrame:
    """Detection on every transformed note: (transform, n_gold, n_found, n_other, and the span scores without rendering)."""
    from siloflow.operators import evaluate, pii

    moved = moved.repartition(moved.sparkSession.sparkContext.defaultParallelism)  # else the detector would be planned once for each transform
    got = pii.detect(moved, note, into="_p").select("transform", F.col(note).alias("note_text"), F.col(spans).alias("t_spans"), F.col("_p").alias("p_spans"))
    got = got.withColumn("p_text", S.render(F.col("note_text"), F.col("p_spans")))
    told = evaluate.score_spans(got, "transform", "transform")
    return told.select("transform", F.col("te").alias("n_gold"), F.col("e").alias("n_found"), (F.col("pe") - F.col("e")).alias("n_other"), "char_f1", "label_char_f1", "entity_f1", "leakage_rate", "exact_render_rate", "composite")
