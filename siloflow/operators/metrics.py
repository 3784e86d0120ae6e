"""Scores: confusion counts, tolerance and category scores, ranking and calibration metrics, all as aggregates.

Ranking metrics need running counts over the scores. Scores are first counted by value, then cut into
BUCKETS ranges whose totals are added up before the ranges are looked into, so that no task has to
order all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1024
CLIP = 1e-7
NULL_TOKEN = "__NULL__"
# The weights of the composite scores.
DEID_WEIGHTS = {"char_f1": 0.55, "entity_f1": 0.25, "label_char_f1": 0.15, "exact_render": 0.05}
EXTRACTION_WEIGHTS = {"diagnoses": 0.22, "medications": 0.22, "numeric": 0.40, "categorical": 0.16}
PREDICTION_WEIGHTS = {"auc": 0.55, "ap": 0.25, "brier": 0.20}
OVERALL_WEIGHTS = {"deid": 0.375, "extraction": 0.375, "prediction": 0.25}
POINTS = {"deid": 15.0, "extraction": 15.0, "prediction": 10.0}


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return safe_div(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_div(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_div(2 * tp, 2 * tp + fp + fn)


def normal_token(x: Column) -> Column:
    """Trimmed lower case with hyphens as underscores and single blanks; null becomes a word of its own."""
    plain = F.regexp_replace(F.replace(F.lower(x.cast("string")), F.lit("-"), F.lit("_")), r"\s+", " ")
    return F.coalesce(F.trim(plain), F.lit(NULL_TOKEN))


def normal_list(xs: Column) -> Column:
    """Distinct sorted normal tokens without blank ones; null is the empty list."""
    tokens = F.transform(F.filter(xs, lambda x: x.isNotNull() & (F.trim(x) != "")), normal_token)
    return F.coalesce(F.array_sort(F.array_distinct(tokens)), F.array().cast("array<string>"))


def numeric_value(x: Column) -> Column:
    """A finite double, or null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def probability(p: Column) -> Column:
    """Clipped to 0..1; what is no number counts as 0.5."""
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def tolerance_score(truth: Column, pred: Column, tol: Column | float) -> Column:
    """1 within the tolerance, falling to 0 at three tolerances; both null is right, one null is wrong."""
    tol = tol if isinstance(tol, Column) else F.lit(float(tol))
    err = F.abs(truth - pred)
    partial = F.greatest(F.lit(0.0), 1.0 - (err - tol) / (2.0 * tol))
    return F.when(truth.isNull() & pred.isNull(), 1.0).when(truth.isNull() | pred.isNull(), 0.0).when(err <= tol, 1.0).otherwise(partial)


def numeric_field(rows: DataFrame, truth: str, pred: str, tol: Column | float, *by: str) -> DataFrame:
    """mean score, share within tolerance, mean absolute error over pairs that both sides have."""
    score = tolerance_score(F.col(truth), F.col(pred), tol)
    both = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(score).alias("score"),
        F.avg((score >= 1.0).cast("double")).alias("within_tolerance"),
        F.avg(F.when(both, F.abs(F.col(truth) - F.col(pred)))).alias("mae"),
    )


def set_field(rows: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    """Micro counts over two arrays of distinct tokens."""
    size = lambda c: F.sum(F.size(c)).cast("long")
    counts = rows.groupBy(*by).agg(
        size(F.array_intersect(truth, pred)).alias("tp"), size(F.array_except(pred, truth)).alias("fp"), size(F.array_except(truth, pred)).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def category_field(rows: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    same = (normal_token(F.col(truth)) == normal_token(F.col(pred))).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(same).alias("accuracy"))


def entity_confusion(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of exact spans (key, start, end, label), each label and, as null, all of them."""
    on = [key, "start", "end", "label"]
    both = truth.select(*on).distinct().withColumn("_t", F.lit(1)).join(pred.select(*on).distinct().withColumn("_p", F.lit(1)), on, "full")
    tp, fp, fn = F.col("_t").isNotNull() & F.col("_p").isNotNull(), F.col("_t").isNull(), F.col("_p").isNull()
    counts = both.cube("label").agg(F.grouping("label").alias("_all"), F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"))
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    scored = counts.withColumns({"precision": precision(c[0], c[1]), "recall": recall(c[0], c[2]), "f1": f1(*c)})
    return scored.withColumn("label", F.when(F.col("_all") == 1, None).otherwise(F.col("label"))).drop("_all")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null; the keys come once."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *rest)


def _counted(rows: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """(by, p, tp, fp, ctp, cfp, pos, neg): counts at each score and at or above it."""
    at = rows.groupBy(*by, F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("double")).alias("tp"), F.sum(1.0 - F.col(y).cast("double")).alias("fp"))
    at = at.withColumn("_b", F.floor(F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0)) * BUCKETS))
    top = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy(*by, "_b").agg(F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    every = Window.partitionBy(*by)
    totals = totals.select(*by, "_b", zero(F.sum("_tp").over(top)).alias("_atp"), zero(F.sum("_fp").over(top)).alias("_afp"), F.sum("_tp").over(every).alias("pos"), F.sum("_fp").over(every).alias("neg"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_null_safe(at, totals, [*by, "_b"])
    return joined.withColumns({"ctp": F.col("_atp") + F.sum("tp").over(inside), "cfp": F.col("_afp") + F.sum("fp").over(inside)})


def ranking(rows: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """(by, auc, ap): ties count half for the area, and as one threshold for the average precision; null without both classes (ap: without positives)."""
    by_ = list(by) or ["_one"]
    rows = rows if by else rows.withColumn("_one", F.lit(1))
    c = _counted(rows, y, p, by_)
    area = F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / F.lit(2.0)))
    steps = F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    pos, neg = F.max("pos"), F.max("neg")
    out = c.groupBy(*by_).agg(F.when((pos > 0) & (neg > 0), area / (pos * neg)).alias("auc"), F.when(pos > 0, steps / pos).alias("ap"))
    return out if by else out.drop("_one")


def calibration(rows: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """(by, n, prevalence, mean_predicted, brier, log_loss)."""
    t, q = F.col(y).cast("double"), F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(t).alias("prevalence"), F.avg(q).alias("mean_predicted"),
        F.avg((q - t) * (q - t)).alias("brier"), F.avg(-(t * F.log(q) + (1.0 - t) * F.log(1.0 - q))).alias("log_loss"),
    )


def composite(auc: Column, ap: Column, brier: Column) -> Column:
    w = PREDICTION_WEIGHTS
    return w["auc"] * F.coalesce(auc, F.lit(0.5)) + w["ap"] * F.coalesce(ap, F.lit(0.0)) + w["brier"] * (1.0 - brier)


def binary_metrics(rows: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """Calibration, ranking and the composite, in one row for each group."""
    by_ = list(by) or ["_one"]
    rows = rows if by else rows.withColumn("_one", F.lit(1))
    left, right = calibration(rows, y, p, *by_), ranking(rows, y, p, *by_)
    out = _join_null_safe(left, right, by_).select(*by_, "n", "prevalence", "mean_predicted", "auc", "ap", "brier", "log_loss")
    out = out.withColumn("composite", composite(F.col("auc"), F.col("ap"), F.col("brier")))
    return out if by else out.drop("_one")


def metrics_by_site(rows: DataFrame, y: str, p: str, site: str) -> DataFrame:
    """A row for each site, one for all of them (site null), and the least defined area over the sites in every row."""
    each = binary_metrics(rows, y, p, site)
    every = binary_metrics(rows, y, p).select(F.lit(None).cast("string").alias(site), "*")
    worst = each.agg(F.min("auc").alias("worst_site_auc"))
    return every.unionByName(each).crossJoin(F.broadcast(worst))  # one row


def summarize(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, std (0 for one value), min and max of the finite values."""
    v = F.when(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")), F.col(value))
    std = F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), std.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def summarize_metrics(rows: DataFrame, *by: str, names: tuple[str, ...] = ("auc", "ap", "brier", "log_loss", "composite")) -> DataFrame:
    """(by, metric, n, mean, std, min, max) of metric columns over repeats."""
    long = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("_v")) for n in names))))
    return summarize(long, "_v", *by, "metric")


#: Counts up to which a Poisson count is drawn from its table; above, by the normal distribution with its mean and spread.
POISSON_TABLE = 50
POISSON_MOST = 120


def _uniform(*what: Column) -> Column:
    """A number in [0, 1) that follows from the values, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(w.cast("string") for w in what))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bootstrap_auc_ci(rows: DataFrame, y: str, p: str, n_boot: int = 2000, seed: int = 0, resolution: int = 10_000) -> DataFrame:
    """The 2.5 and 97.5 percentiles of the area over Poisson resamples within each class.

    Rows are counted by class and score, which is cut to one part in ``resolution``; in a resample the c rows of a score come
    Poisson(c) times, as they do when each row is drawn anew. So no row is numbered, and what is resampled has a bounded size.
    """
    score = F.floor(F.col(p).cast("double") * resolution)
    counted = rows.select(F.col(y).cast("int").alias("_y"), score.alias("_b")).groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    terms = lambda n: F.transform(F.sequence(F.lit(0), F.lit(POISSON_MOST)), lambda k: F.exp(-n + k * F.log(n) - F.log(F.factorial(F.least(k, F.lit(20)))) - F.aggregate(F.when(k > 20, F.sequence(F.lit(21), k)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, j: a + F.log(j.cast("double")))))
    upto = lambda n: F.transform(F.sequence(F.lit(1), F.lit(POISSON_MOST + 1)), lambda k: F.aggregate(F.slice("_t", F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    table = rows.sparkSession.range(1, POISSON_TABLE + 1).select(F.col("id").alias("_n"), terms(F.col("id").cast("double")).alias("_t")).select("_n", upto(None).alias("_cdf"))
    boots = rows.sparkSession.range(n_boot).withColumnRenamed("id", "boot")
    drawn = counted.join(F.broadcast(table), "_n", "left").crossJoin(F.broadcast(boots))  # resolution times n_boot rows at most
    u, v = _uniform(F.lit(seed), F.col("boot"), F.col("_y"), F.col("_b")), _uniform(F.lit(seed), F.col("boot"), F.col("_y"), F.col("_b"), F.lit("v"))
    drawn = drawn.withColumns({"_u": u, "_v": v})
    normal = F.sqrt(-2.0 * F.log(1.0 - F.col("_u"))) * F.cos(F.lit(6.283185307179586) * F.col("_v"))
    wide = F.greatest(F.lit(0.0), F.bround(F.col("_n") + F.sqrt(F.col("_n").cast("double")) * normal))
    times = F.when(F.col("_cdf").isNull(), wide).otherwise(F.size(F.filter("_cdf", lambda x: x < F.col("_u"))).cast("double"))
    counts = drawn.select("boot", "_b", "_y", times.alias("_k")).groupBy("boot", "_b").agg(F.sum(F.when(F.col("_y") == 1, F.col("_k")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("_y") == 0, F.col("_k")).otherwise(0.0)).alias("fp"))
    below = F.coalesce(F.sum("fp").over(Window.partitionBy("boot").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = counts.withColumn("_won", F.col("tp") * (below + F.col("fp") / 2.0)).groupBy("boot").agg(F.sum("_won").alias("w"), F.sum("tp").alias("p"), F.sum("fp").alias("n"))
    areas = won.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))
    return areas.agg(F.count("auc").alias("n_boot"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))
