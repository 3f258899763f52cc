"""The registered queries of the corpus operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import ann, contamination, licenses, lm, neardup, pii, quality, secrets, tokens
from inkwell.llm.common import table


def op1_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where the installation keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_field, op2_multiprobe_neighbours, op3_lm_score, op4_near_duplicates, op5_secret_scan, op6_quality_score, op7_license_scan, op8_token_count, op9_bpe_codec, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": neardup.ORACLE_SQL, "op10_decontamination": contamination.ORACLE_SQL}
