"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and calls one operator of
siloflow.llm. All but the last return the columns of documents; the last one adds the shard each row is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloflow.llm import compaction, decontam, langid, mixing, neardup
from siloflow.llm.common import cut, read

#: Texts whose best language has a lower posterior are rejected.
MIN_LANG_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from this stage's labelled rows; texts without a letter, or that no language claims, go."""
    found = langid.identify(docs.select(F.struct(*docs.columns).alias("_all"), "text"), langid.fit(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANG_SCORE)).select("_all.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return neardup.keep_one(docs, neardup.Spec(k=5, num=100, den=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a test item's five-word shingles go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice comes twice."""
    return mixing.repeat(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows from the files of the committed version, each with its shard."""
    store = compaction.shard(docs)
    version = store.version()
    return store.snapshot(version).withColumn("_shard_version", F.lit(version).cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding),
]

#: Training a classifier has no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
