"""The registered opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siloflow.llm import compaction, decontam, htmltext, langid, licenses, mixing, neardup, pii, quality, secretscan
from siloflow.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op2(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.op3(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.op4(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op5(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op8(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op9(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_license_scan": op5_license_scan,
    "op6_pii": op6_pii,
    "op7_quality_rules": op7_quality_rules,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_main_text": op9_main_text,
    "op10_mixing": op10_mixing,
}
