"""Features of a case and per-site statistics: moments, standardisation, profile.

A missing value is NULL, never NaN: aggregates then pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siloflow.operators.extraction import DIAGNOSES
from siloflow.sources.notes import SITES

LABS = ("heart_rate_bpm", "systolic_bp_mmhg", "creatinine_mg_dl", "hemoglobin_g_dl", "lvef_percent")
#: Feature sets in their fixed order.
SETS = {
    "compact": (
        "age_years", "prior_admissions_12m", "length_of_stay_days", "emergency_admission", *(f"site_{s}" for s in SITES),
        "dx_heart_failure", "dx_chronic_kidney_disease", "dx_atrial_fibrillation", "dx_copd", "dx_type_2_diabetes", "dx_coronary_artery_disease",
    ),
    "extended": (
        "age_years", "sex_male", "prior_admissions_12m", "length_of_stay_days", "emergency_admission", *(f"site_{s}" for s in SITES),
        *(f"dx_{d}" for d in DIAGNOSES), *LABS, *(f"missing_{f}" for f in LABS), "n_medications", "smoking_current", "smoking_former",
    ),
}
LEAST_STD = 1e-8


def feature_columns(record: str = "structured_features", extracted: str = "extracted_clinical_data", site: str = "hospital_id") -> dict[str, Column]:
    """Every feature by name. An age of 0 counts as missing, other missing counts as 0."""
    r, x = (lambda f: F.col(f"{record}.{f}")), (lambda f: F.col(f"{extracted}.{f}"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = {
        "age_years": F.nullif(r("age_years"), F.lit(0)).cast("double"),
        "sex_male": flag(r("sex") == "male"),
        "prior_admissions_12m": F.coalesce(r("prior_admissions_12m"), F.lit(0)).cast("double"),
        "length_of_stay_days": F.coalesce(r("length_of_stay_days"), F.lit(0)).cast("double"),
        "emergency_admission": flag(r("emergency_admission")),
        "n_medications": F.coalesce(F.size(x("medications")), F.lit(0)).cast("double"),
        "smoking_current": flag(x("smoking_status") == "current"),
        "smoking_former": flag(x("smoking_status") == "former"),
    }
    out |= {f"site_{s}": flag(F.col(site) == s) for s in SITES}
    out |= {f"dx_{d}": flag(F.array_contains(x("diagnoses"), d)) for d in DIAGNOSES}
    out |= {f: x(f).cast("double") for f in LABS}
    return out | {f"missing_{f}": x(f).isNull().cast("double") for f in LABS}


def with_features(cases: DataFrame, feature_set: str = "compact", **columns: str) -> DataFrame:
    if feature_set not in SETS:
        raise KeyError(f"unknown feature set {feature_set!r}; there are {sorted(SETS)}")
    every = feature_columns(**columns)
    return cases.withColumns({name: every[name] for name in SETS[feature_set]})


def moments(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    """n_f, s_f and q_f (count, sum and sum of squares of what is not missing) of each feature f: all that a site tells."""
    parts = []
    for f in names:
        c = F.col(f).cast("double")
        parts += [F.count(c).cast("double").alias(f"n_{f}"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{f}"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias(f"q_{f}")]
    return rows.groupBy(*by).agg(*parts)


def standardizer(site_moments: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std) from the sites' moments; a constant feature gets a deviation of 1."""
    total = site_moments.agg(*(F.sum(f"{m}_{f}").alias(f"{m}_{f}") for f in names for m in "nsq"))
    long = total.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n"), F.col(f"s_{f}").alias("s"), F.col(f"q_{f}").alias("q")) for f in names))))
    n = F.greatest(F.col("n"), F.lit(1.0))
    mean = F.col("s") / n
    std = F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0)))
    return long.select("feature", mean.alias("mean"), F.when(std < LEAST_STD, 1.0).otherwise(std).alias("std"))


def scaler_dict(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """On the driver: a row for each feature."""
    return {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}


def standardized(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing values become the mean, that is 0."""
    return rows.withColumns({f: (F.coalesce(F.col(f).cast("double"), F.lit(m)) - F.lit(m)) / F.lit(s) for f, (m, s) in scaler.items()})


def profile(rows: DataFrame, names: list[str], label: str, *by: str) -> DataFrame:
    """How the sites differ: rows, share of positives, mean of each feature, to three places."""
    means = [F.round(F.avg(F.col(f).cast("double")), 3).alias(f) for f in names]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(label).cast("double")), 3).alias("prevalence"), *means)
