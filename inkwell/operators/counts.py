"""Group counts with empty groups filled in, and the collection's statistics in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.schema import BUCKETS, KINDS, STATUSES


def dense_counts(df: DataFrame, **values: tuple[str, ...]) -> DataFrame:
    """Counts by the named columns with a zero for every combination of the given values that doesn't occur."""
    grid = df.sparkSession.range(1)
    for name, allowed in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, allowed))))
    n = df.groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, list(values), "left").select(*values, F.coalesce("n", F.lit(0)).alias("n"))


def by_status(entries: DataFrame) -> DataFrame:
    return dense_counts(entries, status=STATUSES)


def by_kind(entries: DataFrame) -> DataFrame:
    return dense_counts(entries, content_kind=KINDS)


def by_kind_and_status(entries: DataFrame) -> DataFrame:
    return dense_counts(entries, content_kind=KINDS, status=STATUSES)


def all_levels(entries: DataFrame) -> DataFrame:
    """(content_kind, status, n) for each pair, kind, status and the whole, in one scan."""
    rows = entries.groupingSets([["content_kind", "status"], ["content_kind"], ["status"], []], "content_kind", "status")
    return rows.agg(F.count(F.lit(1)).alias("n"))


def pending(entries: DataFrame, bucket_rows: DataFrame) -> DataFrame:
    """(content_kind, total, relevant, filtered, pending): entries not yet in a bucket, never below zero."""
    wide = bucket_rows.groupBy("content_kind").agg(*(F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b) for b in BUCKETS))
    rows = by_kind(entries).join(wide, "content_kind", "left").select("content_kind", F.col("n").alias("total"), *(F.coalesce(b, F.lit(0)).alias(b) for b in BUCKETS))
    return rows.withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("relevant") - F.col("filtered")))


def citing(references: DataFrame, entry_id: int) -> DataFrame:
    """Distinct entries that cite the entry, itself left out."""
    return references.where((F.col("cited_entry_id") == entry_id) & (F.col("citing_entry_id") != entry_id)).select("citing_entry_id").distinct().orderBy("citing_entry_id")


def categories(sources: DataFrame, entries: DataFrame) -> DataFrame:
    return sources.select("category").union(entries.select("category")).where("category is not null").distinct().orderBy(F.lower("category"), "category")


def run_totals(runs: DataFrame) -> DataFrame:
    """Sums of a refresh over all sources."""
    return runs.agg(F.sum("created").alias("created"), F.sum("updated").alias("updated"), F.count_if(F.col("error") != "").alias("failures"))


def joined_text(rows: DataFrame, group: str, text: str, order: list[str]) -> DataFrame:
    """Texts of a group joined by line ends, latest first (by ``order`` descending)."""
    keyed = F.struct(*order, text)
    return rows.groupBy(group).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(keyed))), lambda s: s[text]), "\n").alias("joined"))
