"""The training-corpus pipeline: each stage calls one operator and is written before the next reads it.

1. quality: documents that the quality classifier rejects go.
2. near_duplicates: one document of each group of near duplicates (a similarity of 0.80 and more) stays (the smallest id).
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret in a text is replaced by a mark, and n_chars follows the text.
5. encoding: the token ids of every whole text.

Rows with a null id or text are kept by every stage that has nothing against them: an empty text is scored like any other,
has no shingles, no items, no secrets and no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import contamination, neardup, quality, secrets, tokens
from inkwell.llm.common import stored, table
from inkwell.llm.queries import vocabulary


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as 1; null ids and empty texts are scored like others, no rows give no rows."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"), "quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of similarity 0.80 and more; empty texts have no partners, null ids stay, an id's repeated rows stay together."""
    return neardup.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at a containment of 0.8; empty texts hold none, every repeated row is judged alike."""
    return contamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, each secret of its text replaced by a mark and n_chars set to the new length; a null text stays null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every row; a null or empty text has none."""
    return tokens.encode_with_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: Learned classifiers and tokenisers can't be stated in SQL: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
