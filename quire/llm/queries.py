"""The contract queries of the operators: thin functions of (spark, sf_dir), and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import fingerprints, jpeg, licenses, mixing, near_duplicates, packing, pii, toxicity, url_filter, warc
from quire.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.query(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.query(table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_templates": op2_url_templates,
    "op3_pii": op3_pii,
    "op4_jpeg": op4_jpeg,
    "op5_licenses": op5_licenses,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_pack": op7_pack,
    "op8_mix": op8_mix,
    "op9_warc": op9_warc,
    "op10_fingerprints": op10_fingerprints,
}
ORACLE_SQL: dict[str, str] = {
    "op5_licenses": licenses.oracle_sql(),
    "op6_near_duplicates": near_duplicates.ORACLE_SQL,
    "op8_mix": mixing.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
}
