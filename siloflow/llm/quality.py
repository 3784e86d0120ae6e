"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of every text are array expressions within its row, so nothing is shuffled. The list is
learned by sequential covering: from a bounded, seeded sample of labelled rows, thresholds are taken
at quantiles, rows are counted by the bins they fall into, and a rule (a conjunction of threshold
conditions that speaks for low quality) is grown on two thirds and pruned on the other third; rows it
covers are set aside and the next rule is sought. The list becomes one ordered CASE expression.
Windows of words are told apart by 64-bit hashes of their words, so two windows of one text count as one with a chance of 2**-64 for each pair.

Edge cases: null text has no words and fails the base rule. Without labelled rows, or with one class
only, the list is empty and everything that passes the base rule is kept. Labels that are null or
whose doc_id is null teach nothing; a doc_id with several labels teaches with each. Repeated rows get
a result row each. Extra columns stay in ``with_statistics``, where columns of the statistics' names
are replaced, and are ignored by ``op7``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.llm.common import cut, small, tidy, words

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Expected number of labelled rows the list is learned from, and the bins for each statistic.
MAX_TRAIN_ROWS = 20_000
BINS = 12
#: A rule must be this precise on rows that it was not grown on, and cover this share of the sample's low-quality rows.
MIN_PRECISION = 0.9
MIN_SHARE = 0.01
MAX_CONDITIONS = 4
MAX_RULES = 12
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "line_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares the rules use."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    step1 = docs.withColumns({"_b": body, "_w": words(F.col(text)), "_l": lines})
    windows = F.when(F.size("_w") < WINDOW, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("_w") - WINDOW, F.lit(0))),
                lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
            )
        )
    )
    chars = F.length("_b")
    step2 = step1.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": _without(F.col("_b"), BLANKS).cast("long"),
            "n_symbols": (chars - _without(F.col("_b"), SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_n_lines": F.size("_l"),
            "_upper": chars - _without(F.col("_b"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_digits": chars - _without(F.col("_b"), "0123456789"),
            "_s": windows,
        }
    ).drop("_b", "_w", "_l")
    twice = F.filter("_s", lambda x, k: F.coalesce((k > 0) & (F.get("_s", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)))
    step3 = step2.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_s")
    step4 = step3.withColumn(
        "n_repeat_words",
        F.aggregate(F.transform("_p", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - v, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x),
    ).drop("_p")
    # a partition's number, which is never below 0, keeps later filters above: pushed below, they would copy the staged columns into each other over and over
    step4 = step4.withColumn("n_words", F.when(F.spark_partition_id() >= 0, F.col("n_words")))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return step4.withColumns(
        {
            "mean_word": per("word_chars", "n_words"),
            "symbol_share": per("n_symbols", "word_chars"),
            "dup_line_share": per("n_dup_lines", "_n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
            "upper_share": per("_upper", "word_chars"),
            "digit_share": per("_digits", "word_chars"),
            "line_words": per("n_words", "_n_lines"),
        }
    ).drop("_n_lines", "_upper", "_digits")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return f"low if {' and '.join(map(str, self.conditions))}  [precision {self.precision:.3f}, covers {self.covered}]"


def low_quality(rules: list[Rule]) -> Column:
    """The ordered conditional expression; the first rule that holds decides."""
    if not rules:
        return F.lit(False)
    out = F.when(rules[0].column(), F.lit(True))
    for rule in rules[1:]:
        out = out.when(rule.column(), F.lit(True))
    return out.otherwise(F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """Statistics of a seeded sample of labelled documents; the sampled ids are broadcast while their count is small enough."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("low"))
    n = usable.count()
    rate = int(min(1.0, max_rows / max(n, 1)) * 1_000_000)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    sampled = usable.where(drawn < rate) if rate < 1_000_000 else usable
    own = docs.where(drawn < rate) if rate < 1_000_000 else docs
    return with_statistics(own.select("doc_id", "text").join(small(sampled, n * rate // 1_000_000, 16), "doc_id")).select("doc_id", "low", *FEATURES)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, seed: int = 1) -> list[Rule]:
    """The decision list; thresholds and counts come from Spark, the covering works on at most ``max_rows`` counted bins."""
    rows = cut(training_rows(docs, labels, max_rows, seed))
    grid = rows.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES)).first()
    grids = {f: sorted({float(v) for v in grid[f] or []}) for f in FEATURES}
    bins = [sum(((F.col(f) > v).cast("int") for v in grids[f]), F.lit(0)).alias(f) for f in FEATURES]
    part = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(3)) == 0).alias("prune")
    counted = rows.select(part, "low", *bins).groupBy("prune", "low", *FEATURES).agg(F.count("*").alias("n")).collect()
    return cover([r.asDict() for r in counted], grids)


class _Weighted:
    """Sets of counted rows as bit masks, split into powers of two of their counts for fast weighing."""

    def __init__(self, counts: list[int]):
        self.planes = [(1 << b, int("0" + "".join("01"[n >> b & 1] for n in reversed(counts)), 2)) for b in range(max(counts, default=0).bit_length())]

    def __call__(self, mask: int) -> int:
        return sum(w * (mask & plane).bit_count() for w, plane in self.planes)


def cover(rows: list[dict], grids: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over counted bins; ``rows`` have prune, low, n and a bin number for each feature."""
    weigh = _Weighted([r["n"] for r in rows])
    mask = lambda test: int("0" + "".join("1" if test(r) else "0" for r in reversed(rows)), 2)
    low, grow = mask(lambda r: r["low"]), mask(lambda r: not r["prune"])
    everything = (1 << len(rows)) - 1
    conditions = {}
    for f, values in grids.items():
        for b, v in enumerate(values):
            above = mask(lambda r, f=f, b=b: r[f] > b)
            conditions[Condition(f, True, v)] = above
            conditions[Condition(f, False, v)] = everything & ~above
    left, rules = everything, []
    floor = max(3, MIN_SHARE * weigh(low))
    for _ in range(MAX_RULES):
        chosen: list[Condition] = []
        inside = left & grow
        p, n = weigh(inside & low), weigh(inside & ~low)
        while p and n and len(chosen) < MAX_CONDITIONS:
            best = (0.0, None, 0, 0, 0)
            for c, m in conditions.items():
                p1 = weigh(inside & m & low)
                if p1 < floor / 2:
                    continue
                n1 = weigh(inside & m & ~low)
                gain = p1 * (log2(p1 / (p1 + n1)) - log2(p / (p + n)))
                if gain > best[0] + 1e-9:
                    best = (gain, c, p1, n1, inside & m)
            if best[1] is None:
                break
            _, c, p, n, inside = best
            chosen.append(c)
        if not chosen:
            break
        worth = []
        for k in range(1, len(chosen) + 1):
            held = left & ~grow
            for c in chosen[:k]:
                held &= conditions[c]
            p, n = weigh(held & low), weigh(held & ~low)
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        kept = chosen[: -max(worth)[1]]
        covered = left
        for c in kept:
            covered &= conditions[c]
        p, n = weigh(covered & ~grow & low), weigh(covered & ~grow & ~low)
        if not p or p / (p + n) < MIN_PRECISION or weigh(covered & low) < floor:
            break
        rules.append(Rule(tuple(kept), p / (p + n), weigh(covered)))
        left &= ~covered
    return rules


@tidy
def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    rules = learn(docs, labels)
    got = with_statistics(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~low_quality(rules)).alias("kept"))
