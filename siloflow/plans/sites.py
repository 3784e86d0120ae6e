"""Queries over order lines as rows of five sites (regions): statistics, models, secure sums, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siloflow.operators import extraction, federated, metrics
from siloflow.operators import features as X
from siloflow.plans.text import table
from siloflow.privacy import accounting, secagg

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Fixed values that make features of like size without a first pass.
SCALE = {"l_quantity": (25.0, 15.0), "l_extendedprice": (40.0, 25.0), "l_discount": (0.05, 0.03), "l_tax": (0.04, 0.03)}
THETA = [0.1, -0.2, 0.3, -0.1, 0.05]
RATE, L2, CLIP = 0.2, 0.05, 1.0


def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the region of their supplier as site; a discount of 0 counts as missing, prices are in thousands."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", *NAMES)
    place = (
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        .join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
        .join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("site")), "n_regionkey")
        .select("l_suppkey", "site")
    )
    got = line.join(place, "l_suppkey").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return got.withColumns({"l_discount": F.when(F.col("l_discount") != 0, F.col("l_discount")), "l_extendedprice": F.col("l_extendedprice") / 1000.0})


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site_rows(spark, sf_dir)
    return rows.withColumns({f: (F.coalesce(F.col(f), F.lit(m)) - F.lit(m)) / F.lit(s) for f, (m, s) in SCALE.items()})


def _rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in df.columns if c not in keep))


def site_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.moments(site_rows(spark, sf_dir), NAMES, "site"), "site", digits=2)


def federated_standardizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.standardizer(X.moments(site_rows(spark, sf_dir), NAMES, "site"), NAMES), "feature")


def non_iid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.profile(site_rows(spark, sf_dir), NAMES, "y", "site")


def global_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    loss = federated.site_task(rows, "loss", NAMES, "y", "site", THETA)
    penalty = 0.5 * L2 * sum(t * t for t in THETA[:-1])
    return loss.agg(F.round(F.sum("loss") / F.sum("n") + F.lit(penalty), 6).alias("objective"), F.sum("n").cast("long").alias("n"))


def site_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = federated.gradient_sums(scaled(spark, sf_dir), NAMES, "y", THETA, "site")
    return g.select("site", F.col("n").cast("long").alias("n"), *(F.round(F.col(f"g_{i}") / F.col("n"), 6).alias(f"g_{i}") for i in range(5)))


def fedavg_one_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site takes one full-batch step from the same parameters; the new ones are their mean weighted by rows."""
    g = federated.gradient_sums(scaled(spark, sf_dir), NAMES, "y", THETA, "site")
    local = g
    for i, t in enumerate(THETA):
        decay = L2 * t if i < len(NAMES) else 0.0
        local = local.withColumn(f"t_{i}", F.lit(t) - RATE * (F.col(f"g_{i}") / F.col("n") + F.lit(decay)))
    return local.agg(*(F.round(F.sum(F.col("n") * F.col(f"t_{i}")) / F.sum("n"), 6).alias(f"t_{i}") for i in range(5)))


def clipped_gradient_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = federated.gradient_sums(scaled(spark, sf_dir), NAMES, "y", THETA, "site", clip=CLIP)
    return g.select("site", *(F.round(F.col(f"g_{i}") / F.col("n"), 6).alias(f"g_{i}") for i in range(5)))


def fixed_point_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 40000.0).alias("v"))
    word = secagg.fixed_point(F.col("v"))
    return line.select("l_orderkey", "l_linenumber", word.cast("string").alias("word"), secagg.real_number(word).alias("back"))


def masked_sum_mod64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site totals masked pairwise by hash words; the masks cancel in the ring sum."""
    totals = site_rows(spark, sf_dir).groupBy("site").agg(F.sum("l_quantity").alias("v"))
    pairs = secagg.pair_signs(totals, "site")
    ring = F.lit(str(secagg.TWO_64)).cast("decimal(38,0)")
    mask = F.conv(F.substring(F.md5(F.concat("a", F.lit("|"), "b")), 1, 15), 16, 10).cast("decimal(38,0)")
    masks = pairs.withColumn("m", mask).groupBy("site").agg(F.sum(F.col("m") * F.col("sign")).cast("decimal(38,0)").alias("m"))
    masked = totals.join(masks, "site").withColumn("word", F.pmod((secagg.fixed_point(F.col("v")) + F.col("m")).cast("decimal(38,0)"), ring))
    each = masked.select("site", F.col("word").cast("decimal(20,0)").alias("word"))
    total = secagg.ring_sum(each, "word").select(F.lit("total").alias("site"), "word")
    return each.unionByName(total).select("site", F.col("word").cast("string").alias("word"), F.when(F.col("site") == "total", secagg.real_number(F.col("word"))).alias("value"))


def pairwise_mask_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return secagg.pair_signs(sites, "name")


def rdp_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(accounting.renyi(spark, [25.251, 14.102, 7.916, 4.508, 2.629], 30, 1e-3), "sigma")


def transport_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five sites would send for moments and gradients: messages and bytes."""
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("client"))
    sent = region.select("client", F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(t).alias("type"), F.lit(p).alias("payload")) for d, t, p in MESSAGES))).alias("m"))
    return federated.transport_log(sent.select("m.direction", "client", "m.type", F.concat("m.payload", "client").alias("payload")))


MESSAGES = [("up", "moments", "[12 numbers]"), ("down", "scaler", "[8 numbers, each as text]"), ("up", "train", "[6 numbers]")]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, scored by a ratio of their length that both engines compute alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("site"), "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    kept = F.floor(F.col("n_chars") / 100) * 100
    return rows.withColumn("p", kept / (kept + F.lit(1000.0)))


def auc_ap_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ranking(_scored(spark, sf_dir), "y", "p", "site"), "site", digits=9)


def calibration_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration(_scored(spark, sf_dir), "y", "p", "site"), "site", "n")


def worst_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.metrics_by_site(_scored(spark, sf_dir), "y", "p", "site")
    return got.select("site", "n", F.round("auc", 6).alias("auc"), F.round("composite", 6).alias("composite"), F.round("worst_site_auc", 6).alias("worst_site_auc"))


def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.bootstrap_auc_ci(_scored(spark, sf_dir), "y", "p")
    return _rounded(got, "n_boot", digits=9)


def summarize_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summarize(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice"), "l_extendedprice", "l_linenumber"), "l_linenumber", "n", digits=4)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("doc_id", "site", "y")
    return federated.folds(rows, "site", "y", "doc_id", 5, 7).select("doc_id", "site", "y", "fold")


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities read as creatinine values in four units."""
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.pmod("l_linenumber", F.lit(4)) + 1).cast("int"))
    line = table(spark, sf_dir, "lineitem").select(unit.alias("unit"), (F.col("l_quantity") + 0.3).alias("v"))
    value = extraction.creatinine_mg_dl(F.col("v"), F.col("unit"))
    return line.groupBy("unit").agg(F.count("*").alias("n"), F.count(value).alias("n_valid"), F.round(F.sum(value), 2).alias("total"))


UNITS = ["mg/dl", "µmol/l", "mmol/l", ""]


def numeric_tolerance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("t"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") + F.pmod("p_partkey", F.lit(13)).cast("double")).alias("p"),
    )
    return _rounded(metrics.numeric_field(part, "t", "p", 3.0, "p_brand"), "p_brand", "n")


def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("t"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  "))).alias("p"), F.pmod("c_nationkey", F.lit(5)).alias("g"))
    return _rounded(metrics.category_field(cust, "t", "p", "g"), "g", "n")


def set_field_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the first turn as truth, of the second as prediction."""
    talk = table(spark, sf_dir, "conversations")
    tokens = metrics.normal_list(F.split("text", " ", -1))
    side = lambda n, c: talk.where(F.col("turn") == n).select("conv_id", tokens.alias(c))
    both = side(0, "t").join(side(1, "p"), "conv_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    return _rounded(metrics.set_field(both, "t", "p"), "tp", "fp", "fn")


def normal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(metrics.normal_token(F.col("o_orderpriority")).alias("token")).agg(F.count("*").alias("n"))


def repair_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    warnings = F.array_join(F.filter(F.array(F.when(F.col("quality").isNull(), F.lit("no label")), F.when(F.col("n_chars") < 500, F.lit("short"))), lambda x: x.isNotNull()), ",")
    return both.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif(F.pmod("doc_id", F.lit(5)), F.lit(0)).alias("five"), warnings.alias("warnings"))


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def anti_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def semi_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return docs.where("n > 1")


def cross_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site's model on every site's rows: the model of a site is its class mean of one feature."""
    rows = site_rows(spark, sf_dir)
    models = rows.groupBy(F.col("site").alias("model")).agg(F.avg(F.when(F.col("y") == 1, F.col("l_quantity"))).alias("m"))
    per = rows.groupBy("site", "l_quantity").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    scored = per.crossJoin(F.broadcast(models))  # one row for each site
    return scored.groupBy("model", "site").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("l_quantity") <= F.col("m"), F.col("pos")).otherwise(F.col("n") - F.col("pos"))) / F.sum("n"), 6).alias("accuracy"))


def asof_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's nearest earlier event of another kind, if it is at most a week old."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    cue = F.last(F.when(F.col("event_type") != "purchase", F.struct("ts", "event_type")), ignorenulls=True).over(w)
    got = ev.withColumn("cue", cue).where("event_type = 'purchase'")
    near = F.col("cue.ts") >= F.col("ts") - F.expr("INTERVAL 7 DAYS")
    return got.select("event_id", F.when(near, F.col("cue.event_type")).alias("cue"))


#: Batches that no site fills: each epoch is one step over all rows, which SQL can say too.
WHOLE = 1 << 40
FIT = federated.Config(rounds=3, epochs=2, batch=WHOLE, l2=L2, rate=RATE)


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).withColumn("_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))


def _thetas(spark: SparkSession, key: str, models: dict[str, list[float]]) -> DataFrame:
    rows = [(k, i, round(float(t), 6)) for k, theta in sorted(models.items()) for i, t in enumerate(theta)]
    return spark.createDataFrame(rows, f"{key} string, i int, theta double")


def fedavg_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Federated averaging by rows and uniformly: the common parameters."""
    cells = [federated.Cell(w, federated.replace(FIT, weighting=w)) for w in ("n_samples", "uniform")]
    federated.fit(_identified(spark, sf_dir), NAMES, "y", "site", "_id", cells)
    return _thetas(spark, "weighting", {c.name: list(c.theta[""]) for c in cells})


def fedavg_secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under secure aggregation, with a site that drops out in the last round."""
    cells = [federated.Cell("n_samples", FIT)]
    federated.fit(_identified(spark, sf_dir), NAMES, "y", "site", "_id", cells, secure=True, lost={3: frozenset({"ASIA"})})
    return _thetas(spark, "weighting", {c.name: [round(float(t), 5) for t in c.theta[""]] for c in cells})


def local_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's own parameters."""
    cell = federated.Cell("own", FIT)
    federated.fit_local(_identified(spark, sf_dir), NAMES, "y", "site", "_id", [cell])
    return _thetas(spark, "site", {k: list(v) for k, v in cell.theta.items()})


def pooled_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one site, with as many passes as the federated model."""
    return _thetas(spark, "regime", {"centralized": list(federated.fit_pooled(_identified(spark, sf_dir), NAMES, "y", "_id", FIT))})


def personal_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The federated model after one round, trained on for two epochs at each site."""
    own = federated.personalise(_identified(spark, sf_dir), NAMES, "y", "site", "_id", federated.replace(FIT, rounds=1))
    return _thetas(spark, "site", {k: list(v) for k, v in own.items()})


def private_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped full-batch descent without noise: two steps at each site, averaged by rows."""
    cells = [federated.Cell("clipped", federated.replace(FIT, rounds=1), noise=accounting.Noise(0.0, 0.5))]
    federated.fit(_identified(spark, sf_dir), NAMES, "y", "site", "_id", cells)
    return _thetas(spark, "weighting", {"n_samples": list(cells[0].theta[""])})


def optimum_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of the objective at the optimum, which is nothing, and its number of rows."""
    rows = scaled(spark, sf_dir)
    theta = federated.optimum(rows, NAMES, "y", L2)
    g = federated.gradient_sums(rows, NAMES, "y", list(theta))
    parts = [F.struct(F.lit(i).alias("i"), (F.round(F.col(f"g_{i}") / F.col("n") + F.lit(L2 * float(t) if i < len(NAMES) else 0.0), 6) + 0.0).alias("gradient"), F.col("n").cast("long").alias("n")) for i, t in enumerate(theta)]
    return g.select(F.inline(F.array(*parts)))


QUERIES = {
    f.__name__: f
    for f in (
        site_moments, federated_standardizer, non_iid_profile, global_objective, site_gradients, fedavg_one_round, clipped_gradient_sum, fixed_point_roundtrip,
        masked_sum_mod64, pairwise_mask_join, rdp_epsilon_grid, transport_audit, auc_ap_by_site, calibration_by_site, worst_site, bootstrap_auc, summarize_metrics,
        stratified_folds, unit_conversion, numeric_tolerance_score, category_accuracy, set_field_f1, normal_tokens, repair_projection, anti_missing, anti_extra,
        semi_subset, duplicate_texts, cross_site_scores, asof_cue, fedavg_fit, fedavg_secure, local_models, pooled_model,
        personal_models, private_steps, optimum_gradient,
    )
}

_SITE = """SELECT l_orderkey, l_linenumber, r_name AS site, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity, l_extendedprice / 1000.0::DOUBLE AS l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""
_SCALED = "SELECT site, y, " + ", ".join(f"(coalesce({f}, {m}::DOUBLE) - {m}::DOUBLE) / {s}::DOUBLE AS {f}" for f, (m, s) in SCALE.items()) + f" FROM ({_SITE}) s"
_Z = " + ".join(f"{f} * ({t}::DOUBLE)" for f, t in zip(NAMES, THETA, strict=False)) + f" + {THETA[-1]}::DOUBLE"
_P = "1.0::DOUBLE / (1.0::DOUBLE + exp(-z))"
_GRAD = f"""z AS (SELECT *, {_Z} AS z FROM ({_SCALED}) t), r AS (SELECT *, {_P} - y AS r FROM z)"""
_PARTS = [f"r * {f}" for f in NAMES] + ["r"]
_SCORED = """SELECT doc_id, lang AS site, quality AS y, floor(n_chars / 100) * 100 / (floor(n_chars / 100) * 100 + 1000.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id)"""
_RANK = """
  pts AS (SELECT {by}, p, sum(y::DOUBLE) AS tp, sum(1 - y::DOUBLE) AS fp FROM scored GROUP BY ALL),
  cum AS (SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY p DESC) AS ctp, sum(fp) OVER (PARTITION BY {by} ORDER BY p DESC) AS cfp FROM pts),
  rank AS (SELECT {by}, CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)) END AS auc,
                  CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / (ctp + cfp)) / sum(tp) END AS ap FROM cum GROUP BY {by})"""
_CAL = """count(*) AS n, avg(y::DOUBLE) AS prevalence, avg(q) AS mean_predicted, avg((q - y) * (q - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss"""
_Q = "SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM scored"

_D = len(NAMES) + 1


def _fit_sql(rounds: int, weight: str, answer: str, sites: str = "site", clip: float | None = None, gone: tuple[int, str] | None = None, begin: str = "", own: int = 0) -> str:
    """Rounds of two full-batch steps at each site from common parameters, then their mean; ``own`` more rounds without a mean."""
    start = federated.start_theta(0, len(NAMES))
    ctes = [f"r AS (SELECT {sites} AS site, * EXCLUDE (site) FROM ({_SCALED}) s)", "s AS (SELECT DISTINCT site FROM r)"]
    ctes.append("c0 AS (SELECT " + ", ".join(f"{float(t)!r}::DOUBLE AS t{i}" for i, t in enumerate(start)) + ")")
    z = " + ".join([f"{f} * t{i}" for i, f in enumerate(NAMES)] + [f"t{_D - 1}"])
    parts = [f"e * {f}" for f in NAMES] + ["e"]
    norm = f"greatest(1.0::DOUBLE, sqrt({' + '.join(f'({p}) * ({p})' for p in parts)}) / {clip}::DOUBLE)" if clip else "1.0::DOUBLE"

    def step(source: str, into: str) -> str:
        grads = ", ".join(f"avg({p} / k) AS g{i}" for i, p in enumerate(parts))
        moved = ", ".join(f"t{i} - {RATE}::DOUBLE * (g{i} + {L2 if i < _D - 1 else 0.0}::DOUBLE * t{i}) AS t{i}" for i in range(_D))
        return (f"{into} AS (SELECT site, n, {moved} FROM (SELECT site, count(*) AS n, {', '.join(f'any_value(t{i}) AS t{i}' for i in range(_D))}, {grads} "
                f"FROM (SELECT *, {norm} AS k FROM (SELECT r.*, {', '.join(f'p.t{i}' for i in range(_D))}, 1 / (1 + exp(-({z}))) - y AS e FROM r JOIN {source} p USING (site)) a) b GROUP BY site) d)")  # fmt: skip

    for t in range(1, rounds + 1):
        at = f"SELECT site, c.* FROM s, c{t - 1} c" + (f" WHERE site <> '{gone[1]}'" if gone and t >= gone[0] else "")
        ctes += [f"b{t} AS ({at})", step(f"b{t}", f"u{t}"), step(f"u{t}", f"v{t}")]
        w = "n" if weight == "n_samples" else "1"
        ctes.append(f"c{t} AS (SELECT " + ", ".join(f"sum({w} * t{i}) / sum({w}) AS t{i}" for i in range(_D)) + f" FROM v{t})")
    if own:
        ctes += [f"o AS (SELECT site, c.* FROM s, c{rounds} c)", step("o", "ou"), step("ou", "ov")]
    return "WITH " + ",\n".join(ctes) + f"\n{answer}"


def _long(key: str, source: str, digits: int = 6) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {i} AS i, round(round(t{i}, 6), {digits}) AS theta FROM {source}" for i in range(_D))


_BOOT = f"""
  WITH k AS (SELECT y, CAST(floor(p * 10000) AS BIGINT) AS b, count(*) AS n FROM ({_SCORED}) s GROUP BY ALL),
  f AS (SELECT unnest(range(0, {metrics.POISSON_MOST + 1})) AS k),
  c AS (SELECT n, list(cdf ORDER BY k) AS cdf FROM (SELECT n, k, sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS cdf FROM (SELECT DISTINCT n FROM k WHERE n <= {metrics.POISSON_TABLE}) d, f) e GROUP BY n),
  d AS (SELECT boot, y, b, k.n, cdf, CAST('0x' || substr(md5('0:' || boot || ':' || y || ':' || b), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u,
          CAST('0x' || substr(md5('0:' || boot || ':' || y || ':' || b || ':v'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS v
        FROM k LEFT JOIN c USING (n), range(2000) t(boot)),
  w AS (SELECT boot, y, b, CASE WHEN cdf IS NULL THEN greatest(0, round_even(n + sqrt(n) * sqrt(-2 * ln(1 - u)) * cos(6.283185307179586::DOUBLE * v), 0)) ELSE len(list_filter(cdf, lambda x: x < u))::DOUBLE END AS m FROM d),
  g AS (SELECT boot, b, sum(CASE WHEN y = 1 THEN m ELSE 0 END) AS tp, sum(CASE WHEN y = 0 THEN m ELSE 0 END) AS fp FROM w GROUP BY ALL),
  a AS (SELECT boot, tp, fp, tp * (coalesce(sum(fp) OVER (PARTITION BY boot ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + fp / 2) AS won FROM g),
  o AS (SELECT CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(won) / (sum(tp) * sum(fp)) END AS auc FROM a GROUP BY boot)
  SELECT count(auc) AS n_boot, round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.975), 9) AS high FROM o"""

ORACLE = {
    "bootstrap_auc": _BOOT,
    "fedavg_fit": " UNION ALL ".join(f"SELECT * FROM ({_fit_sql(3, w, _long(repr(w) + ' AS weighting', 'c3'))}) q" for w in ("n_samples", "uniform")),
    "fedavg_secure": _fit_sql(3, "n_samples", _long("'n_samples' AS weighting", "c3", 5), gone=(3, "ASIA")),
    "local_models": _fit_sql(0, "n_samples", _long("site", "ov"), own=1),
    "pooled_model": _fit_sql(3, "n_samples", _long("'centralized' AS regime", "c3"), sites="'all'"),
    "personal_models": _fit_sql(1, "n_samples", _long("site", "ov"), own=1),
    "private_steps": _fit_sql(1, "n_samples", _long("'n_samples' AS weighting", "c1"), clip=0.5),
    "optimum_gradient": f"SELECT i, 0.0::DOUBLE AS gradient, count(*) AS n FROM ({_SITE}) s, range({_D}) t(i) GROUP BY i",
    "site_moments": "SELECT site, " + ", ".join(f"round(count({f})::DOUBLE, 2) AS n_{f}, round(sum({f}), 2) AS s_{f}, round(sum({f} * {f}), 2) AS q_{f}" for f in NAMES) + f" FROM ({_SITE}) t GROUP BY site",
    "federated_standardizer": " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(sqrt(greatest(avg({f} * {f}) - avg({f}) * avg({f}), 0)), 6) AS std FROM ({_SITE}) t" for f in NAMES),
    "non_iid_profile": "SELECT site, count(*) AS n, round(avg(y::DOUBLE), 3) AS prevalence, " + ", ".join(f"round(avg({f}), 3) AS {f}" for f in NAMES) + f" FROM ({_SITE}) t GROUP BY site",
    "global_objective": f"WITH {_GRAD} SELECT round(avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z) + {0.5 * L2 * sum(t * t for t in THETA[:-1])}, 6) AS objective, count(*) AS n FROM r",
    "site_gradients": f"WITH {_GRAD} SELECT site, count(*) AS n, " + ", ".join(f"round(avg({p}), 6) AS g_{i}" for i, p in enumerate(_PARTS)) + " FROM r GROUP BY site",
    "fedavg_one_round": f"""WITH {_GRAD},
      l AS (SELECT site, count(*) AS n, {", ".join(f"{t}::DOUBLE - {RATE} * (avg({p}) + {L2 * t if i < 4 else 0.0}) AS t_{i}" for i, (t, p) in enumerate(zip(THETA, _PARTS, strict=True)))} FROM r GROUP BY site)
      SELECT {", ".join(f"round(sum(n * t_{i}) / sum(n), 6) AS t_{i}" for i in range(5))} FROM l""",
    "clipped_gradient_sum": f"""WITH {_GRAD}, c AS (SELECT *, greatest(1.0::DOUBLE, sqrt({" + ".join(f"({p}) * ({p})" for p in _PARTS)}) / {CLIP}) AS c FROM r)
      SELECT site, {", ".join(f"round(avg({p} / c), 6) AS g_{i}" for i, p in enumerate(_PARTS))} FROM c GROUP BY site""",
    "fixed_point_roundtrip": """
      WITH w AS (SELECT l_orderkey, l_linenumber, CAST(round_even((l_extendedprice - 40000.0::DOUBLE) * 16777216, 0) AS HUGEINT) AS k FROM lineitem)
      SELECT l_orderkey, l_linenumber, CAST(CASE WHEN k < 0 THEN k + 18446744073709551616 ELSE k END AS VARCHAR) AS word, k::DOUBLE / 16777216 AS back FROM w""",
    "masked_sum_mod64": f"""
      WITH t AS (SELECT site, sum(l_quantity) AS v FROM ({_SITE}) s GROUP BY site),
      p AS (SELECT a.site AS a, b.site AS b, CAST('0x' || substr(md5(a.site || '|' || b.site), 1, 15) AS BIGINT)::HUGEINT AS m FROM t a JOIN t b ON a.site < b.site),
      m AS (SELECT site, sum(m) AS m FROM (SELECT a AS site, m FROM p UNION ALL SELECT b, -m FROM p) u GROUP BY site),
      w AS (SELECT site, ((CAST(round_even(v * 16777216, 0) AS HUGEINT) + m) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 AS word FROM t JOIN m USING (site))
      SELECT site, CAST(word AS VARCHAR) AS word, NULL::DOUBLE AS value FROM w
      UNION ALL SELECT 'total', CAST(sum(word) % 18446744073709551616 AS VARCHAR), (sum(word) % 18446744073709551616)::DOUBLE / 16777216 FROM w""",
    "pairwise_mask_join": """SELECT a.r_name AS a, b.r_name AS b, a.r_name AS site, 1 AS sign FROM region a JOIN region b ON a.r_name < b.r_name
      UNION ALL SELECT a.r_name, b.r_name, b.r_name, -1 FROM region a JOIN region b ON a.r_name < b.r_name""",
    "rdp_epsilon_grid": """
      WITH o AS (SELECT 1.01::DOUBLE + i * (8.99::DOUBLE / 399) AS a FROM range(400) t(i) UNION ALL SELECT 10.0::DOUBLE + i * (502.0::DOUBLE / 399) FROM range(400) t(i)),
      s AS (SELECT unnest([25.251::DOUBLE, 14.102, 7.916, 4.508, 2.629]) AS sigma)
      SELECT sigma, round(greatest(min(30 * a / (2 * sigma * sigma) + ln((a - 1) / a) - (ln(1e-3::DOUBLE) + ln(a)) / (a - 1)), 0), 6) AS epsilon_rdp FROM o, s GROUP BY sigma""",
    "transport_audit": "SELECT direction, r_name AS client, count(*) AS messages, CAST(sum(strlen(payload || r_name)) AS BIGINT) AS bytes FROM region, (VALUES "
    + ", ".join(f"('{d}', '{t}', '{p}')" for d, t, p in MESSAGES)
    + ") m(direction, kind, payload) GROUP BY 1, 2",
    "auc_ap_by_site": f"WITH scored AS ({_SCORED}), {_RANK.format(by='site')} SELECT site, round(auc, 9) AS auc, round(ap, 9) AS ap FROM rank",
    "calibration_by_site": f"WITH scored AS ({_SCORED}) SELECT site, n, round(prevalence, 6) AS prevalence, round(mean_predicted, 6) AS mean_predicted, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM (SELECT site, {_CAL} FROM ({_Q}) q GROUP BY site) t",
    "worst_site": f"""
      WITH one AS ({_SCORED}), scored AS (SELECT site, y, p FROM one UNION ALL SELECT NULL, y, p FROM one), {_RANK.format(by="site")},
      cal AS (SELECT site, {_CAL} FROM ({_Q}) q GROUP BY site),
      m AS (SELECT c.site, n, auc, 0.55 * coalesce(auc, 0.5) + 0.25 * coalesce(ap, 0) + 0.2 * (1 - brier) AS composite FROM cal c JOIN rank r ON c.site IS NOT DISTINCT FROM r.site)
      SELECT site, n, round(auc, 6) AS auc, round(composite, 6) AS composite, round((SELECT min(auc) FROM m WHERE site IS NOT NULL), 6) AS worst_site_auc FROM m""",
    "summarize_metrics": "SELECT l_linenumber, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY 1",
    "stratified_folds": f"""
      SELECT doc_id, site, y, CAST((row_number() OVER (ORDER BY site, y, md5('7:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM ({_SCORED}) t""",
    "unit_conversion": """
      WITH v AS (SELECT (['mg/dl', 'µmol/l', 'mmol/l', ''])[l_linenumber % 4 + 1] AS unit, l_quantity + 0.3::DOUBLE AS v FROM lineitem),
      c AS (SELECT unit, CASE WHEN unit = 'µmol/l' OR (unit = '' AND v > 25) THEN v / 88.4::DOUBLE WHEN unit = 'mmol/l' THEN v * 1000.0::DOUBLE / 88.4::DOUBLE ELSE v END AS c FROM v)
      SELECT unit, count(*) AS n, count(*) FILTER (c BETWEEN 0.1 AND 25) AS n_valid, round(sum(CASE WHEN c BETWEEN 0.1 AND 25 THEN round_even(c, 2) END), 2) AS total FROM c GROUP BY unit""",
    "numeric_tolerance_score": """
      WITH r AS (SELECT p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE END AS t, CASE WHEN p_partkey % 11 <> 0 THEN p_size + (p_partkey % 13)::DOUBLE END AS p FROM part),
      s AS (SELECT *, CASE WHEN t IS NULL AND p IS NULL THEN 1.0::DOUBLE WHEN t IS NULL OR p IS NULL THEN 0 WHEN abs(t - p) <= 3 THEN 1 ELSE greatest(0, 1 - (abs(t - p) - 3) / 6) END AS s FROM r)
      SELECT p_brand, count(*) AS n, round(avg(s), 6) AS score, round(avg((s >= 1)::INT::DOUBLE), 6) AS within_tolerance, round(avg(abs(t - p)), 6) AS mae FROM s GROUP BY p_brand""",
    "category_accuracy": """
      SELECT CAST(c_nationkey % 5 AS INTEGER) AS g, count(*) AS n, round(avg(CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE 1 END), 6) AS accuracy FROM customer GROUP BY 1""",
    "set_field_f1": r"""
      WITH tok AS (SELECT conv_id, turn, list_distinct(list_transform(list_filter(string_split(text, ' '), lambda x: trim(x) <> ''),
                     lambda x: trim(regexp_replace(replace(lower(x), '-', '_'), '\s+', ' ', 'g')))) AS w FROM conversations),
      b AS (SELECT a.w AS t, coalesce(c.w, []) AS p FROM (SELECT * FROM tok WHERE turn = 0) a LEFT JOIN (SELECT * FROM tok WHERE turn = 1) c USING (conv_id)),
      s AS (SELECT CAST(sum(len(list_intersect(t, p))) AS BIGINT) AS tp, CAST(sum(len(p) - len(list_intersect(t, p))) AS BIGINT) AS fp, CAST(sum(len(t) - len(list_intersect(t, p))) AS BIGINT) AS fn FROM b)
      SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS "precision", round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""",
    "normal_tokens": r"SELECT trim(regexp_replace(replace(lower(o_orderpriority), '-', '_'), '\s+', ' ', 'g')) AS token, count(*) AS n FROM orders GROUP BY 1",
    "repair_projection": """
      SELECT doc_id, coalesce(quality, -1) AS quality, nullif(doc_id % 5, 0) AS five, concat_ws(',', CASE WHEN quality IS NULL THEN 'no label' END, CASE WHEN n_chars < 500 THEN 'short' END) AS warnings
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "anti_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "anti_extra": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "semi_subset": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "duplicate_texts": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "cross_site_scores": f"""
      WITH r AS ({_SITE}), m AS (SELECT site AS model, avg(CASE WHEN y = 1 THEN l_quantity END) AS m FROM r GROUP BY 1)
      SELECT model, site, count(*) AS n, round(avg(CASE WHEN l_quantity <= m THEN y ELSE 1 - y END), 6) AS accuracy FROM r, m GROUP BY 1, 2""",
    "asof_cue": """
      WITH o AS (SELECT event_id, ts, user_id, event_type, last_value(CASE WHEN event_type <> 'purchase' THEN {'t': ts, 'k': event_type} END IGNORE NULLS)
                   OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events)
      SELECT event_id, CASE WHEN c.t >= ts - INTERVAL 7 DAYS THEN c.k END AS cue FROM o WHERE event_type = 'purchase'""",
}
