"""Span algebra on array columns: overlap resolution, rendering, validation, overlap lengths.

A span is struct<start:int,end:int,label:string,source:string>, zero-based, end exclusive; ``source`` names
the rule that found it and takes no part in comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("PATIENT_NAME", "DATE_OF_BIRTH", "ENCOUNTER_DATE", "PATIENT_ID", "ADDRESS", "PHONE_NUMBER", "EMAIL", "CLINICIAN_NAME")
SPAN = "struct<start:int,end:int,label:string,source:string>"
SPANS = f"array<{SPAN}>"


def span(start: Column, end: Column, label: str | Column, source: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(start.alias("start"), end.alias("end"), lit(label).alias("label"), lit(source).alias("source"))


def none() -> Column:
    return F.array().cast(SPANS)


def valid(s: Column) -> Column:
    return (s["start"] >= 0) & (s["end"] > s["start"]) & s["label"].isin(*LABELS)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def free_of(spans: Column, taken: Column) -> Column:
    """Those of the spans that overlap none of the taken ones."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: overlap(s, t)))


def resolve(ranked: list[tuple[int, Column]]) -> Column:
    """Greedy resolution: lower priority number first, then the longer, then the earlier, then the order given; sorted by place."""

    def keyed_by(k: int, p: int, spans: Column) -> Column:
        return F.transform(spans, lambda s, i: F.struct(F.lit(p).alias("p"), (s["start"] - s["end"]).alias("len"), s["start"].alias("at"), F.lit(k).alias("k"), i.alias("i"), s.alias("s")))

    keyed = [keyed_by(k, p, spans) for k, (p, spans) in enumerate(ranked)]
    every = F.array_sort(F.concat(*keyed)) if len(keyed) > 1 else F.array_sort(keyed[0])
    kept = F.aggregate(every, none(), lambda acc, x: F.when(F.exists(acc, lambda t: overlap(x["s"], t)), acc).otherwise(F.concat(acc, F.array(x["s"]))))
    return F.array_sort(kept)


def render(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label in brackets; spans must be sorted and disjoint, else the row fails."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        bad = F.raise_error(F.lit("spans overlap")).cast("string")
        piece = F.when(s["start"] < acc["at"], bad).otherwise(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], piece, F.lit("["), s["label"], F.lit("]")).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def validated(spans: Column, n_chars: Column) -> Column:
    """Spans within the text and with a known label, by place, without any that starts before the last kept end."""
    inside = F.filter(F.coalesce(spans, none()), lambda s: F.coalesce(valid(s) & (s["end"] <= n_chars), F.lit(False)))
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out")))
    return F.aggregate(F.array_sort(inside), start, step, lambda acc: acc["out"])


def total_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])


def overlap_length(left: Column, right: Column, same_label: bool = False) -> Column:
    """Code points that both sides cover, each side being disjoint within itself."""

    def common(a: Column, b: Column) -> Column:
        n = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
        return F.when(a["label"] == b["label"], n).otherwise(F.lit(0)) if same_label else n

    return F.aggregate(left, F.lit(0), lambda acc, a: acc + F.aggregate(right, F.lit(0), lambda acc2, b: acc2 + common(a, b)))


def to_json(spans: Column) -> Column:
    """Without provenance."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
