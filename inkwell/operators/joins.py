"""Joins of the collection. A side is broadcast only through Spark's own size check, never by a hint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_sources(entries: DataFrame, sources: DataFrame) -> DataFrame:
    return entries.join(sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "category"), "source_id")


def with_rankings(entries: DataFrame, rankings: DataFrame, profile_id: int) -> DataFrame:
    """Entries that the profile has scored, with score and bucket."""
    own = rankings.where(F.col("profile_id") == profile_id).select(F.col("entry_id").alias("id"), "score", "bucket")
    return entries.join(own, "id")


def category_counts(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """(category, n) with categories of no entries; entries are summed up by source before the join."""
    n = entries.groupBy("source_id").agg(F.count("id").alias("n"))
    return sources.join(n, sources["id"] == n["source_id"], "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy("category")


def bucket_counts(rankings: DataFrame, profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """(content_kind, bucket, n) of rankings whose profile and entry are of one kind."""
    kinds = entries.select(F.col("id").alias("entry_id"), F.col("content_kind").alias("kind"))
    rows = rankings.join(profiles.select(F.col("id").alias("profile_id"), "content_kind"), "profile_id").join(kinds, "entry_id")
    return rows.where(F.col("kind") == F.col("content_kind")).groupBy("content_kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


def references_with_targets(references: DataFrame, entries: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """Citations with their target's title (null where unresolved), and its export state."""
    target = entries.select(F.col("id").alias("cited_entry_id"), F.col("title").alias("target_title"), F.col("status").alias("target_status"))
    rows = references.join(target, "cited_entry_id", "left")
    if exports is not None:
        rows = rows.join(exports.select(F.col("entry_id").alias("cited_entry_id"), F.col("state").alias("export_state")), "cited_entry_id", "left")
    return rows


def resolved_by_identifier(references: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Open citations (no target, a key) with the smallest entry that has the identifier and isn't the citing one."""
    open_ = references.where(F.col("cited_entry_id").isNull() & (F.coalesce("value", F.lit("")) != ""))
    pairs = open_.join(identifiers.select("scheme", "value", "entry_id"), ["scheme", "value"]).where("entry_id <> citing_entry_id")
    return pairs.groupBy("id").agg(F.min("entry_id").alias("target"))


def resolved_by_url(references: DataFrame, entries: DataFrame) -> DataFrame:
    """Open citations with the smallest entry of their address, by url or canonical url: two equality joins."""
    open_ = references.where(F.col("cited_entry_id").isNull() & (F.coalesce("url", F.lit("")) != ""))
    address = entries.select(F.col("url").alias("u"), F.col("id").alias("entry_id")).unionByName(entries.select(F.col("canonical_url").alias("u"), F.col("id").alias("entry_id"))).where("u <> ''").distinct()
    pairs = open_.join(address, open_["url"] == address["u"]).where("entry_id <> citing_entry_id")
    return pairs.groupBy(open_["id"]).agg(F.min("entry_id").alias("target"))


def reconciled(references: DataFrame, identifiers: DataFrame, entries: DataFrame) -> DataFrame:
    """References with open targets filled: by identifier first, then by address."""
    one = resolved_by_identifier(references, identifiers).withColumnRenamed("target", "by_id")
    two = resolved_by_url(references, entries).withColumnRenamed("target", "by_url")
    rows = references.join(one, "id", "left").join(two, "id", "left")
    return rows.withColumn("cited_entry_id", F.coalesce("cited_entry_id", "by_id", "by_url")).select(references.columns)


def without_skips(items: DataFrame, skips: DataFrame) -> DataFrame:
    return items.join(skips, ["source_id", "guid"], "left_anti")


def import_difference(incoming: DataFrame, existing: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Each incoming row with action created, updated or unchanged against ``existing``."""
    old = existing.select(key, F.lit(True).alias("_known"), *(F.col(c).alias(f"_old_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    action = F.when(F.col("_known").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return incoming.join(old, key, "left").select(*incoming.columns, action.alias("action"))


def ambiguous(candidates: DataFrame, work: str = "work_id") -> DataFrame:
    """Works whose identifiers lead to more than one entry."""
    return candidates.groupBy(work).agg(F.countDistinct("entry_id").alias("entries")).where("entries > 1")


def cache_probe(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts with the cached vector of their hash under the model, or null."""
    hashed = texts.withColumn("content_hash", F.sha2("text", 256))
    return hashed.join(cache.where(F.col("model") == model).select("content_hash", "vector"), "content_hash", "left")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
