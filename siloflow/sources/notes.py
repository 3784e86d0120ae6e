"""Reading, repairing and writing case records (JSON lines), with fixed schemas.

A record is one JSON object on a line. Reading is strict: a line that is no object of the schema stops the
job, naming file and line where that can be told. Repairing never stops: it says in a list what it changed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sites and the fields of a record.
SITES = ("BERLIN_NODE", "CHENNAI_NODE", "HYDERABAD_NODE")
UNKNOWN_SITE = "UNKNOWN"
FEATURES_SCHEMA = "struct<age_years:int,sex:string,prior_admissions_12m:int,length_of_stay_days:int,emergency_admission:boolean>"
SPAN_SCHEMA = "array<struct<start:int,end:int,label:string>>"
EXTRACTED_SCHEMA = (
    "struct<diagnoses:array<string>,medications:array<string>,heart_rate_bpm:int,systolic_bp_mmhg:int,creatinine_mg_dl:double,"
    "hemoglobin_g_dl:double,lvef_percent:int,smoking_status:string,allergy:string>"
)
INPUT_SCHEMA = f"case_id string, hospital_id string, note_text string, structured_features {FEATURES_SCHEMA}"
LABELS_SCHEMA = f"struct<pii_entities:{SPAN_SCHEMA},extracted_clinical_data:{EXTRACTED_SCHEMA},readmission_30d:int>"
TRAIN_SCHEMA = f"{INPUT_SCHEMA}, labels {LABELS_SCHEMA}"
TRUTH_SCHEMA = f"case_id string, hospital_id string, pii_entities {SPAN_SCHEMA}, deidentified_text string, extracted_clinical_data {EXTRACTED_SCHEMA}, readmission_30d int"
PREDICTION_SCHEMA = f"case_id string, pii_entities {SPAN_SCHEMA}, deidentified_text string, extracted_clinical_data {EXTRACTED_SCHEMA}, readmission_probability double"


def read_jsonl(spark: SparkSession, path: str, schema: str = INPUT_SCHEMA) -> DataFrame:
    """Records of a file or folder; blank lines are passed over, anything that is no JSON object fails the job with the line's text."""
    return parsed(spark.read.text(path), schema)


def parsed(lines: DataFrame, schema: str = INPUT_SCHEMA) -> DataFrame:
    """The same from lines that are at hand in a column ``value``."""
    lines = lines.where(F.trim("value") != "")
    # a top-level array would be taken for several records, so what a line starts with is looked at first
    plain = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.left("value", F.lit(80)))))
    return lines.select(F.from_json(plain, f"struct<{_fields(schema)}>", {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    """name type, ... as name:type, ... of a struct; commas within <> stay."""
    out, depth, item = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = item.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            item = ""
        else:
            item += c
    return ",".join(out)


def as_lines(df: DataFrame) -> DataFrame:
    """One object a line with all fields, null ones too, in a column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with all fields, null ones too."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_site(spark: SparkSession, path: str, site: str, ids: DataFrame | None = None) -> DataFrame:
    """A site's own records from a layout partitioned by site, or a subset of them by case_id."""
    own = spark.read.parquet(path).where(F.col("hospital_id") == site)
    return own if ids is None else own.join(ids, "case_id", "left_semi")


def write_partitioned(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("hospital_id").parquet(path)


def repair(raw: DataFrame) -> DataFrame:
    """Rows with an id, repaired, with _warnings; the loose input has string columns case_id, hospital_id, note_text and structured_features (JSON)."""
    features = F.from_json("structured_features", FEATURES_SCHEMA)
    known = F.col("hospital_id").isin(*SITES)
    said = [
        (F.col("hospital_id").isNull(), "hospital_id is missing"),
        (F.col("hospital_id").isNotNull() & ~known, "hospital_id is unknown"),
        (F.col("note_text").isNull(), "note_text is no string"),
        (features.isNull(), "structured_features is no object"),
    ]
    warnings = F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in said)), lambda x: x.isNotNull())
    nothing = F.from_json(F.lit("{}"), FEATURES_SCHEMA)
    return accepted(raw).select(
        "case_id", F.coalesce("hospital_id", F.lit(UNKNOWN_SITE)).alias("hospital_id"), F.coalesce("note_text", F.lit("")).alias("note_text"),
        F.coalesce(features, nothing).alias("structured_features"), warnings.alias("_warnings"),
    )


def accepted(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("case_id").isNotNull() & (F.col("case_id") != ""))


def rejected(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("case_id").isNull() | (F.col("case_id") == "")).withColumn("_error", F.lit("case_id is missing or empty"))


def labelled(train: DataFrame) -> DataFrame:
    return train.where(F.col("labels.readmission_30d").isin(0, 1))


def attach_labels(inputs: DataFrame, truth: DataFrame) -> DataFrame:
    """Inputs that have a truth; of several truths for one id the one with the greatest label counts."""
    one = truth.groupBy("case_id").agg(F.max("readmission_30d").alias("readmission_30d"))
    return inputs.join(one, "case_id")


def labelled_notes(train: DataFrame, inputs: DataFrame, truth: DataFrame) -> DataFrame:
    """(case_id, note_text, spans, age) of both splits: the labelled one, and inputs with the truth of their id."""
    age = F.col("structured_features.age_years").alias("age")
    here = train.select("case_id", "note_text", F.col("labels.pii_entities").alias("spans"), age)
    there = inputs.join(truth.select("case_id", F.col("pii_entities").alias("spans")), "case_id").select("case_id", "note_text", "spans", age)
    return here.unionByName(there)


def load_split(spark: SparkSession, split: str, train: str, inputs: str, truth: str) -> tuple[DataFrame, DataFrame]:
    """(inputs, truth) of a split by name, from its files; the labelled split holds its truth in itself."""
    if split == "validation":
        return read_jsonl(spark, inputs), read_jsonl(spark, truth, TRUTH_SCHEMA)
    if split != "train":
        raise ValueError(f"there is no split {split!r}")
    from siloflow.functions import spans as S

    rows = read_jsonl(spark, train, TRAIN_SCHEMA)
    shown = S.render(F.col("note_text"), F.array_sort(F.transform("labels.pii_entities", lambda s: S.span(s["start"], s["end"], s["label"], ""))))
    told = rows.select("case_id", "hospital_id", F.col("labels.pii_entities").alias("pii_entities"), shown.alias("deidentified_text"), F.col("labels.extracted_clinical_data").alias("extracted_clinical_data"), F.col("labels.readmission_30d").alias("readmission_30d"))
    return rows.drop("labels"), told


def rounded(value, digits: int = 4):
    """Floats in a nested artifact rounded; the rest as it is."""
    if isinstance(value, float):
        return round(value, digits)
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return [rounded(v, digits) for v in value] if isinstance(value, (list, tuple)) else value


def write_json(path: str, payload: dict) -> None:
    """A small artifact, on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, ensure_ascii=False)
        f.write("\n")


def message_size(payload: Column) -> Column:
    return F.octet_length(F.to_json(payload))
