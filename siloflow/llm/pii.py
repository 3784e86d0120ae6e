"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators of high recall propose spans, which may overlap: the contract's four patterns, loosely
written numbers, and addresses spelled with words for their signs. Each candidate gets a row with its
offsets and small whole-number features of its format and context. Boosted trees of depth two are
fitted on counted feature rows and become a sum of conditional expressions.

No label is a feature. The labels come from the table itself, from all of its documents: candidates of
the base kinds are positive where the contract's rule (check sum, ranges, digits) holds; for loose numbers and spelled addresses, valid phone numbers and mail
addresses are written anew in these forms, where they stand, as positives, and the table's own candidates of these
kinds, outside of valid spans, count as negatives. Examples made by rule from cue words and formats, half of which are no personal data, come
beside them; the counts of a large table are scaled down as a whole, so that it does not drown them. Thresholds are calibrated for each kind by cross-fitting: every row is judged by trees that were fitted without its document
(or, for examples, without its half). Spans
that pass the contract's rules are always kept, what the rules refuse is not added again; the trees add spans of the other kinds beside them.

Matching is done in the scan stage, once: the candidates it finds are written, learned from and judged. Only candidates are shuffled, never texts. Patterns use
possessive runs, so their time is linear in the text.

Edge cases: null text counts as empty and has no span. Rows are told apart by a number given in the scan
stage and used once, so null or repeated ids and repeated rows give a result row each. Empty tables
give empty results; the trees are then fitted on the examples alone. Extra columns are
ignored by ``op6`` and carried by ``redact``. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siloflow.llm.common import cut, tidy

#: The contract's patterns. Starts are held to where a leftmost match can begin, and runs are possessive.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9+])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,6}+\)?)++",
    "words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z]{2,12}+)++",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: What a text must hold for its pattern to be tried.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "number": lambda t: t.rlike(r"[0-9][\x20()./-]+[0-9]"),
    "words": lambda t: t.rlike(r"(?i)[(\[]at[)\]]|\x20at\x20"),
}
BEFORE, AFTER = 32, 4

#: Candidates of all documents are counted for fitting and calibration; the counts of a larger table are scaled to weigh as much as so many documents.
TABLE_WEIGHT = 5_000
ROUNDS, RATE, DEPTH_LAMBDA = 32, 0.4, 1.0
#: An example counts as so many candidates, and a written-anew span as one; of the weights of each kind's two labels the lesser one is not raised.
EXAMPLE_WEIGHT = 5
MIN_PRECISION = 0.95

#: What numbers are written like (9 stands for any digit), by cues before which they are personal data.
PERSONAL = [
    (("phone: ", "call me at ", "tel ", "mobile ", "cell ", "fax: ", "whatsapp ", "telefon "), ("999-999-9999", "(999) 999 9999", "099 999 9999", "99999 99999", "999.999.9999", "09 99 99 99 99", "(999) 999-9999")),
    (("ssn ", "social security number ", "social security "), ("999-99-9999", "999 99 9999")),
    (("born ", "dob ", "date of birth: ", "birthday "), ("19.03.1984", "1984-03-19", "03/19/1984", "19-03-1984")),
    (("credit card ", "amex ", "visa ", "card number "), ("3999 999999 99999", "4999 9999 9999 9999", "5999-9999-9999-9999")),
]
#: Cues before which none of these are, and formats that are none before anything.
IMPERSONAL = (("order ", "invoice no. ", "isbn ", "part ", "serial ", "version ", "page ", "ref "), tuple(f for _, formats in PERSONAL for f in formats))
NUMBERS = (("from ", "in ", "of ", "the ", "", "score ", "between "), ("19.03.1984", "1984-03-19", "03/19/1984", "1990-1995", "12 34 56", "10 20 30 40", "12-10", "120 - 134", "12.50 14.75", "1.2.34", "99-99"))
SPELLED = (("mail ", "email: ", "write to ", "contact ", "reach ", ""), ("jane.roe (at) example (dot) org", "john [at] example [dot] com", "kim at example dot net", "lee.s at mail dot example dot org"))
UNSPELLED = (("looks ", "meet ", "stay ", "they look "), ("at them dot dot dot", "at noon dot com", "them at home dot org pages", "up at night dot dot"))


def _examples() -> list[tuple[int, str]]:
    """(1 for personal data or 0, text), with digits that a fixed generator draws."""
    rng = Random(7)
    drawn = lambda said: "".join(str(rng.randrange(1, 10)) if c == "9" else c for c in said)
    made = [(y, cue + drawn(f)) for y, groups in ((1, [*PERSONAL, SPELLED]), (0, [IMPERSONAL, NUMBERS, UNSPELLED])) for cues, formats in groups for cue in cues for f in formats]
    return [(y, f"{said}{end}") for i, (y, said) in enumerate(made) for end in (("", " ok", ".", ", and")[i % 4],)]


EXAMPLES = _examples()

CUES = [
    (1, r"(?:phone|tel|telefon|telephone|mobile|cell|call|fax|whatsapp|dial|handy)[a-z]*\W*(?:\w+\W+){0,2}$"),
    (2, r"(?:mail|e-mail|email|write|contact|reach)[a-z]*\W*(?:\w+\W+){0,2}$"),
    (3, r"(?:card|visa|amex|mastercard|credit|debit)[a-z]*\W*(?:\w+\W+){0,1}$"),
    (4, r"(?:ssn|social security)(?: (?:number|no))?\W*$"),
    (5, r"(?:born|dob|birth|birthday)\W*(?:on\W+)?$"),
    (6, r"(?:order|invoice|version|release|isbn|page|pages|part|serial|ref|id|score|room|no)\W*(?:no\W+)?$"),
]
FEATURES = ("kind", "digits", "parts", "cue", "edge", "shape", "leading")


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))


def _proposed(kind: str) -> Column:
    """The candidates of one kind as an array; expects _g and _m columns of the kind."""
    g, m = F.col(f"_g_{kind}"), F.col(f"_m_{kind}")
    return F.transform(
        m,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(g, i)).alias("gap"), x.alias("said"),
            F.lower(F.right(F.get(g, i), F.lit(BEFORE))).alias("before"), F.left(F.get(g, i + 1), F.lit(AFTER)).alias("after"),
        ),
    )


def candidates(rows: DataFrame, marker: bool = True) -> DataFrame:
    """(_row, doc_id, kind, said, before, after, start, end) of every candidate, from _row, doc_id and _text.

    With ``marker`` every row also has one candidate of kind -1, so that no row is lost.
    """
    none = F.array().cast("array<string>")
    text = F.col("_text")
    cut_up = rows
    for kind, pattern in PATTERNS.items():
        may = GUARDS[kind](text)
        cut_up = cut_up.withColumn(f"_m_{kind}", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        cut_up = cut_up.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(none))
    found = [_proposed(kind) for kind in KINDS]
    if marker:
        found.append(F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("said"), F.lit("").alias("before"), F.lit("").alias("after"))))
    one = cut_up.select("_row", "doc_id", F.inline(F.concat(*found)))
    upto = Window.partitionBy("_row", "kind").orderBy("i")
    one = one.withColumn("end", F.sum(F.col("gap") + F.length("said")).over(upto))
    return one.withColumn("start", F.col("end") - F.length("said")).select("_row", "doc_id", "kind", "said", "before", "after", "start", "end")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    at = F.sequence(F.lit(1), F.length(digits))
    digit = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise((digit(i) * 2) % 10 + F.floor(digit(i) / 5).cast("int"))
    return F.aggregate(at, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _at_most_255(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) > 3, False).when(bare == "", True).otherwise(bare.cast("int") <= 255)


def with_features(found: DataFrame) -> DataFrame:
    """Append ok (the contract's rule for the kind holds; no feature) and the whole-number features."""
    found = found.withColumn("_d", F.regexp_replace("said", "[^0-9]", "")).withColumn("_n", F.length("_d"))
    is_kind = lambda k: F.col("kind") == KINDS.index(k)
    octets = F.split("said", r"\.")
    ip_ok = F.when(is_kind("ip"), _at_most_255(octets[0]) & _at_most_255(octets[1]) & _at_most_255(octets[2]) & _at_most_255(octets[3]))
    sum_ok = F.when(F.col("_n").between(12, 19), _luhn(F.col("_d"))).otherwise(False)
    ok = (
        F.when(is_kind("email"), True).when(is_kind("ip"), ip_ok)
        .when(is_kind("card"), (F.col("_n") >= 16) & (F.col("_n") <= 19) & sum_ok)
        .when(is_kind("phone"), F.col("_n").between(8, 15)).otherwise(False)
    )
    cue = F.lit(0)
    for value, pattern in reversed(CUES):
        cue = F.when(F.col("before").rlike(pattern), value).otherwise(cue)
    separators = F.length("said") - F.length(F.regexp_replace("said", r"[\x20./()-]", ""))
    shape = (
        F.when(F.col("said").rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 1)
        .when(F.col("said").rlike(r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})$"), 2)
        .when(F.col("said").rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), 3)
        .when(F.col("said").rlike(r"(?i)[(\[]at[)\]]"), 5).when(F.col("said").rlike(r"[A-Za-z]{2,}$"), 4).otherwise(0)
    )
    digits = sum(((F.col("_n") >= n).cast("int") for n in (5, 7, 9, 10, 11, 12, 16, 20)), F.lit(0))
    return found.withColumns(
        {
            "ok": F.coalesce(ok, F.lit(False)),
            "digits": digits,
            "parts": F.least(separators, F.lit(4)),
            "cue": cue,
            "edge": (F.col("before").rlike(r"[a-z0-9]$") | F.col("after").rlike(r"^[A-Za-z0-9]")).cast("int"),
            "shape": shape,
            "leading": F.when(F.col("said").startswith("+"), 1).when(F.col("said").startswith("("), 2).when(F.col("said").startswith("0"), 3).otherwise(0),
        }
    ).drop("_d", "_n")


# ---- boosted trees over counted feature rows


@dataclass(frozen=True)
class Tree:
    """value, or a test (feature, relation, number) with a tree for yes and one for no."""

    value: float = 0.0
    test: tuple[str, str, int] | None = None
    yes: Tree | None = None
    no: Tree | None = None

    def column(self) -> Column:
        if self.test is None:
            return F.lit(float(self.value))
        f, relation, v = self.test
        held = F.col(f) <= v if relation == "<=" else F.col(f) == v
        return F.when(held, self.yes.column()).otherwise(self.no.column())

    def __call__(self, row: dict) -> float:
        if self.test is None:
            return self.value
        f, relation, v = self.test
        return (self.yes if (row[f] <= v if relation == "<=" else row[f] == v) else self.no)(row)


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    thresholds: dict[int, float]

    def margin(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(0.0))

    def selected(self) -> Column:
        out = F.lit(False)
        for kind, least in self.thresholds.items():
            out = F.when(F.col("kind") == kind, self.margin() >= least).otherwise(out)
        return out


def _leaf(g: float, h: float) -> float:
    return -RATE * g / (h + DEPTH_LAMBDA)


def _grow(rows: list[tuple[dict, float, float]], tests: list[tuple[str, str, int]], depth: int) -> Tree:
    """A tree by the gain of second-order boosting; rows are (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if depth == 0 or not rows:
        return Tree(_leaf(g, h))
    worth = lambda a, b: a * a / (b + DEPTH_LAMBDA)
    best = (1e-6, None)
    for f, relation, v in tests:
        inside = [r for r in rows if (r[0][f] <= v if relation == "<=" else r[0][f] == v)]
        if 0 < len(inside) < len(rows):
            gi, hi = sum(r[1] for r in inside), sum(r[2] for r in inside)
            gain = worth(gi, hi) + worth(g - gi, h - hi) - worth(g, h)
            if gain > best[0] + 1e-12:
                best = (gain, (f, relation, v))
    if best[1] is None:
        return Tree(_leaf(g, h))
    f, relation, v = best[1]
    held = lambda r: r[0][f] <= v if relation == "<=" else r[0][f] == v
    return Tree(0.0, best[1], _grow([r for r in rows if held(r)], tests, depth - 1), _grow([r for r in rows if not held(r)], tests, depth - 1))


def boost(rows: list[dict], rounds: int = ROUNDS) -> tuple[Tree, ...]:
    """Trees of depth two for the logistic loss; rows have the features, pos and neg counts."""
    values = {f: sorted({r[f] for r in rows}) for f in FEATURES}
    tests = [(f, "==", v) for f in ("kind", "cue", "shape", "leading") for v in values[f]]
    tests += [(f, "<=", v) for f in ("digits", "parts", "edge") for v in values[f][:-1]]
    margins, trees = [0.0] * len(rows), []
    for _ in range(rounds):
        pulled = []
        for r, m in zip(rows, margins, strict=True):
            p, n = 1 / (1 + exp(-m)), r["pos"] + r["neg"]
            pulled.append((r, p * n - r["pos"], n * p * (1 - p)))
        tree = _grow(pulled, tests, 2)
        trees.append(tree)
        margins = [m + tree(r) for r, m in zip(rows, margins, strict=True)]
    return tuple(trees)


def calibrate(rows: list[dict]) -> dict[int, float]:
    """For each kind but the base ones a threshold above which MIN_PRECISION of the weight is positive and odds are better than even; rows have a margin."""
    out = {}
    for kind in range(len(BASE), len(KINDS)):
        own = sorted(((r["margin"], r["pos"], r["neg"]) for r in rows if r["kind"] == kind), key=lambda x: -x[0])
        pos, neg, best, i = 0, 0, float("inf"), 0
        while i < len(own):
            margin = own[i][0]
            while i < len(own) and own[i][0] == margin:  # equal margins go together
                pos, neg, i = pos + own[i][1], neg + own[i][2], i + 1
            if margin > 0 and pos >= MIN_PRECISION * (pos + neg):
                best = margin
        if best < float("inf"):
            out[kind] = (best + max([0.0, *(m for m, _, _ in own if m < best)])) / 2  # halfway to the next margin below
    return out


def examples(spark: SparkSession) -> DataFrame:
    """(_row, part, y, _text): each is of one of two halves, told by all of it but its digits."""
    return spark.createDataFrame([(i, 1 + i % 2, y, t) for i, (y, t) in enumerate(EXAMPLES)], "_row long, part int, y int, _text string").withColumn("doc_id", F.col("_row"))


def written_anew(found: DataFrame) -> DataFrame:
    """(_row, part, at, _text): valid phone numbers and mail addresses as loose numbers and spelled addresses, between what stood around them."""
    national = F.regexp_replace("said", r"^\+[0-9]{1,3}[\x20.-]*", "")
    with_signs = lambda sign: F.regexp_replace(F.regexp_replace(national, r"^\(", ""), r"[\x20().-]+", sign)
    form = F.pmod(F.xxhash64("said", "start"), F.lit(4))
    phone = F.when(form == 0, national).when(form == 1, with_signs("-")).when(form == 2, with_signs(" ")).otherwise(with_signs("."))
    spelled = lambda at, dot: F.concat(F.substring_index("said", "@", 1), F.lit(at), F.replace(F.substring_index("said", "@", -1), F.lit("."), F.lit(dot)))
    mail = F.when(form == 0, spelled(" (at) ", " (dot) ")).when(form == 1, spelled(" [at] ", " [dot] ")).otherwise(spelled(" at ", " dot "))
    known = found.where(F.col("ok") & F.col("kind").isin(KINDS.index("phone"), KINDS.index("email")))
    said = F.when(F.col("kind") == KINDS.index("phone"), phone).otherwise(mail)
    return known.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "part", F.length("before").alias("at"), F.concat("before", said, "after").alias("_text"))


@tidy
def labelled(found: DataFrame, seed: int = 1) -> DataFrame:
    """(shown, part, features, pos, neg): counts of all candidates by features, and (shown 1) of the examples; part 1 or 2 by document."""
    shown = examples(found.sparkSession)
    told = with_features(candidates(shown.select("_row", "doc_id", "_text"), marker=False)).where(F.col("kind") >= len(BASE)).join(shown.select("_row", "part", "y"), "_row")
    rows = told.select(F.lit(1).alias("shown"), "part", *FEATURES, (F.col("y") * EXAMPLE_WEIGHT).alias("pos"), ((1 - F.col("y")) * EXAMPLE_WEIGHT).alias("neg"))
    part = (1 + F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2))).cast("int")
    seen = found.where("kind >= 0").withColumns({"part": part, "shown": F.lit(0)})
    rows = rows.unionByName(seen.where(F.col("kind") < len(BASE)).select("shown", "part", *FEATURES, F.col("ok").cast("int").alias("pos"), (~F.col("ok")).cast("int").alias("neg")))
    rows = rows.unionByName(seen.where((F.col("kind") >= len(BASE)) & F.col("_free")).select("shown", "part", *FEATURES, F.lit(0).alias("pos"), F.lit(1).alias("neg")))
    anew = cut(written_anew(seen))
    met = with_features(candidates(anew.select("_row", "doc_id", "_text"), marker=False)).join(anew.select("_row", "part", "at"), "_row")
    met = met.where((F.col("kind") >= len(BASE)) & F.col("start").between(F.col("at") - 1, F.col("at") + 1))
    rows = rows.unionByName(met.select(F.lit(0).alias("shown"), "part", *FEATURES, F.lit(1).alias("pos"), F.lit(0).alias("neg")))
    return cut(rows.groupBy("shown", "part", *FEATURES).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def learned(told: DataFrame, n_docs: int) -> Model:
    """Trees and thresholds; only counts of feature rows, whose number the features bound, come to the driver."""
    share = min(1.0, TABLE_WEIGHT / max(n_docs, 1))
    counts: dict[tuple, list[float]] = {}
    for r in told.orderBy("part", *FEATURES, "shown").collect():
        both = counts.setdefault((r["part"], *(r[f] for f in FEATURES)), [0.0, 0.0])
        for i, n in enumerate((r["pos"], r["neg"])):
            both[i] += n * (1.0 if r["shown"] else share)
    rows = [dict(zip(("part", *FEATURES, "pos", "neg"), (*k, *n), strict=True)) for k, n in counts.items()]
    without = {part: boost([r for r in rows if r["part"] != part]) for part in (1, 2)}
    return Model(boost(rows), calibrate([r | {"margin": sum(t(r) for t in without[r["part"]])} for r in rows]))


@tidy
def _labelled(docs: DataFrame, seed: int) -> DataFrame:
    return labelled(cut(gathered(named(docs))), seed)


def fit(docs: DataFrame, seed: int = 1) -> Model:
    return learned(_labelled(docs, seed), docs.count())


# ---- results


def unmet(found: DataFrame) -> DataFrame:
    """Append _free: no valid base span of the row overlaps the candidate."""
    order = Window.partitionBy("_row").orderBy("start", F.col("ok").desc(), "kind", "end")
    above = F.max(F.when(F.col("ok"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    below = F.min(F.when(F.col("ok"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return found.withColumn("_free", (F.coalesce(above, F.lit(0)) <= F.col("start")) & (F.coalesce(below, F.col("end")) >= F.col("end")))


def gathered(rows: DataFrame) -> DataFrame:
    """All candidates with their features, whether the contract's rule holds and whether a valid span overlaps; kind -1 marks each row."""
    return unmet(with_features(candidates(rows)))


def judged(found: DataFrame, model: Model) -> DataFrame:
    """(_row, doc_id, kind, base, start, end): base spans, and those of the trees that overlap none; kind -1 marks each row."""
    chosen = F.col("kind").between(0, len(KINDS) - 1) & F.col("_free") & model.selected()
    return found.where((F.col("kind") < 0) | F.col("ok") | chosen).select("_row", "doc_id", "kind", F.col("ok").alias("base"), "start", "end")


def spans(rows: DataFrame, model: Model) -> DataFrame:
    return judged(gathered(rows), model)


def _name() -> Column:
    name = F.lit("")
    for i, k in enumerate(KINDS):
        name = F.when(F.col("kind") == i, F.when(F.col("base"), k).otherwise(f"trees_{k}")).otherwise(name)
    return name


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; a row for each input row."""
    seen = cut(gathered(named(docs)))
    found = judged(seen, learned(labelled(seen), seen.where("kind < 0").count()))
    order = F.when(F.col("base"), F.col("kind")).otherwise(F.col("kind") + len(KINDS))
    entry = F.struct(order.alias("k"), "start", "end", F.concat_ws(":", _name(), "start", "end").alias("s"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, entry))), lambda x: x["s"]), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(BASE)]
    out = found.groupBy("_row", "doc_id").agg(*counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("kind") >= 0).alias("spans"))
    return out.drop("_row")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; overlapping spans count as one, the earliest. All columns stay."""
    model = model or fit(docs)
    held = cut(docs.select(F.struct(*docs.columns).alias("_all"), F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")))
    found = spans(held.select("_row", "doc_id", "_text"), model).where("kind >= 0")
    entry = F.struct("start", "end", F.regexp_replace(_name(), "^trees_", "").alias("k"))
    listed = found.groupBy("_row").agg(F.sort_array(F.collect_list(entry)).alias("_spans"))
    got = held.join(listed, "_row", "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), F.upper(x["k"]), F.lit("]")).alias("out"))
    )
    tail = lambda a: F.concat(a["out"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), F.length("_text")))
    new = F.when(F.col("_spans").isNull(), F.col("_all.text")).otherwise(F.aggregate("_spans", start, step, tail))
    return got.select(*(new.alias(c) if c == "text" else F.col(f"_all.`{c}`") for c in docs.columns))
