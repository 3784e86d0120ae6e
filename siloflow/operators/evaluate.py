"""Scoring predictions against the truth: spans, extracted fields, probabilities, and the overall composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.functions import spans as S
from siloflow.operators import metrics as M

# Tolerances of the numeric fields, and the categorical ones.
TOLERANCES = {"heart_rate_bpm": 3.0, "systolic_bp_mmhg": 5.0, "creatinine_mg_dl": 0.10, "hemoglobin_g_dl": 0.30, "lvef_percent": 3.0}
CATEGORIES = ("smoking_status", "allergy")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are empty or come more than once."""
    return rows.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull() | (F.col(key).cast("string") == ""))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti").select(key)


def join_all(inputs: DataFrame, truth: DataFrame, pred: DataFrame, key: str = "case_id") -> DataFrame:
    """Truth with its input and prediction; a missing prediction is an empty one."""
    t = truth.select(key, F.col("pii_entities").alias("t_spans"), F.col("deidentified_text").alias("t_text"), F.col("extracted_clinical_data").alias("t_fields"), F.col("readmission_30d").alias("y"))
    p = pred.select(key, F.col("pii_entities").alias("p_spans"), F.col("deidentified_text").alias("p_text"), F.col("extracted_clinical_data").alias("p_fields"), F.col("readmission_probability").alias("p"))
    return inputs.select(key, "hospital_id", "note_text").join(t, key).join(p, key, "left")


def with_valid_spans(rows: DataFrame, spans: tuple[str, ...] = ("t_spans", "p_spans")) -> DataFrame:
    n = F.length("note_text")
    source = lambda c: F.transform(F.col(c), lambda s: S.span(s["start"], s["end"], s["label"], ""))
    return rows.withColumns({c: S.validated(source(c), n) for c in spans})


def score_spans(rows: DataFrame, key: str = "case_id", *by: str) -> DataFrame:
    """Characters (any label, same label), exact entities, rendering, and the de-identification composite; rows have t_spans, p_spans, note_text and p_text."""
    rows = with_valid_spans(rows)
    same = lambda a, b: S.overlap_length(F.col(a), F.col(b), same_label=True)
    entity = lambda c: F.transform(F.col(c), lambda s: F.struct(s["start"], s["end"], s["label"]))
    one = rows.select(
        *by,
        S.overlap_length(F.col("t_spans"), F.col("p_spans")).alias("both"), same("t_spans", "p_spans").alias("same"),
        S.total_length(F.col("t_spans")).alias("t"), S.total_length(F.col("p_spans")).alias("p"),
        F.size(F.array_intersect(entity("t_spans"), entity("p_spans"))).alias("e"), F.size("t_spans").alias("te"), F.size("p_spans").alias("pe"),
        F.coalesce(S.render(F.col("note_text"), F.col("t_spans")) == F.col("p_text"), F.lit(False)).alias("exact"),
    )
    agg = one.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("both", "same", "t", "p", "e", "te", "pe")), F.avg(F.col("exact").cast("double")).alias("exact_render_rate"))
    c = F.col
    agg = agg.withColumns(
        {
            "char_f1": M.f1(c("both"), c("p") - c("both"), c("t") - c("both")),
            "label_char_f1": M.f1(c("same"), c("p") - c("same"), c("t") - c("same")),
            "entity_f1": M.f1(c("e"), c("pe") - c("e"), c("te") - c("e")),
            "leakage_rate": M.safe_div(c("t") - c("both"), c("t")),
            "false_discovery_rate": M.safe_div(c("p") - c("both"), c("p")),
        }
    )
    w = M.DEID_WEIGHTS
    total = w["char_f1"] * c("char_f1") + w["entity_f1"] * c("entity_f1") + w["label_char_f1"] * c("label_char_f1") + w["exact_render"] * c("exact_render_rate")
    return agg.withColumn("composite", total)


def label_f1(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """Exact entities by label, with all eight labels present, and their unweighted mean."""
    rows = with_valid_spans(rows)
    long = lambda c: rows.select(key, F.inline(F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))))
    got = M.entity_confusion(long("t_spans"), long("p_spans"), key).where(F.col("label").isNotNull())
    labels = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, S.LABELS))).alias("label"))
    every = labels.join(got, "label", "left").na.fill(0)
    return every.crossJoin(F.broadcast(every.agg(F.avg("f1").alias("macro_f1"))))  # one row


def score_fields(rows: DataFrame) -> DataFrame:
    """(field, kind, score): sets by micro F1, numbers by tolerance, categories by accuracy; rows have t_fields and p_fields."""
    parts = []
    for f in ("diagnoses", "medications"):
        lists = rows.select(M.normal_list(F.col(f"t_fields.{f}")).alias("t"), M.normal_list(F.col(f"p_fields.{f}")).alias("p"))
        parts.append(M.set_field(lists, "t", "p").select(F.lit(f).alias("field"), F.lit(f).alias("kind"), F.col("f1").alias("score")))
    for f, tol in TOLERANCES.items():
        pair = rows.select(F.col(f"t_fields.{f}").cast("double").alias("t"), F.col(f"p_fields.{f}").cast("double").alias("p"))
        parts.append(M.numeric_field(pair, "t", "p", tol).select(F.lit(f).alias("field"), F.lit("numeric").alias("kind"), "score"))
    for f in CATEGORIES:
        pair = rows.select(F.col(f"t_fields.{f}").alias("t"), F.col(f"p_fields.{f}").alias("p"))
        parts.append(M.category_field(pair, "t", "p").select(F.lit(f).alias("field"), F.lit("categorical").alias("kind"), F.col("accuracy").alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fields_composite(scores: DataFrame) -> DataFrame:
    kinds = scores.groupBy("kind").agg(F.avg("score").alias("score"))
    weight = F.lit(0.0)
    for kind, w in M.EXTRACTION_WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    return kinds.agg(F.sum(weight * F.col("score")).alias("composite"))


def score_probabilities(rows: DataFrame, site: str = "hospital_id") -> DataFrame:
    """Metrics over all rows and by site, with the worst site; invalid probabilities count as 0.5."""
    bad = F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0.0, 1.0)
    return M.metrics_by_site(rows.withColumn("p", F.when(bad, 0.5).otherwise(F.col("p"))), "y", "p", site)


def overall(deid: Column, extraction: Column, prediction: Column) -> Column:
    w, points = M.OVERALL_WEIGHTS, M.POINTS
    parts = {"deid": deid, "extraction": extraction, "prediction": prediction}
    return F.struct(
        sum((w[k] * v for k, v in parts.items()), F.lit(0.0)).alias("composite"), sum((points[k] * v for k, v in parts.items()), F.lit(0.0)).alias("points")
    )


def evaluate(inputs: DataFrame, truth: DataFrame, pred: DataFrame, key: str = "case_id") -> dict:
    """All scores; duplicate ids and truths without an input stop it, missing and unknown predictions are told."""
    for name, rows in (("inputs", inputs), ("truth", truth), ("predictions", pred)):
        if not duplicate_keys(rows, key).isEmpty():
            raise ValueError(f"{name}: an id is empty or comes twice")
    if not missing_keys(truth, inputs, key).isEmpty():
        raise ValueError("a truth has no input")
    rows = join_all(inputs, truth, pred, key).persist()
    try:
        deid = score_spans(rows, key).first().asDict()
        fields = score_fields(rows)
        extraction = fields_composite(fields).first()["composite"]
        by_site = [r.asDict() for r in score_probabilities(rows).collect()]  # a row for each site
        every = next(r for r in by_site if r["hospital_id"] is None)
        total = rows.sparkSession.range(1).select(overall(F.lit(deid["composite"]), F.lit(extraction), F.lit(every["composite"])).alias("o")).first()["o"]
        return {
            "deidentification": deid, "extraction": {"composite": extraction, "fields": {r["field"]: r["score"] for r in fields.collect()}},
            "prediction": {"overall": every, "by_site": [r for r in by_site if r["hospital_id"] is not None]}, "composite": total["composite"], "points": total["points"],
            "missing_predictions": missing_keys(truth, pred, key).count(), "unknown_predictions": missing_keys(pred, truth, key).count(),
        }
    finally:
        rows.unpersist()
