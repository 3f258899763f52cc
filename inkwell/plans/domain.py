"""The collection's tables over the driver's tables, for the registered queries; and the same as DuckDB views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Domain:
    """entries from documents (kind and source by source, status by labels), sources, rankings, feedback, references ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def sources(self) -> DataFrame:
        ids = self.table("documents").select(F.substring("source", 4, 9).cast("long").alias("id")).distinct()
        category = F.element_at(F.array(*map(F.lit, ("Systems", "learning", "Hardware", "Unsorted"))), (F.col("id") % 4 + 1).cast("int"))
        return ids.select(
            "id", F.concat(F.lit("Feed "), "id").alias("title"), F.concat(F.lit("https://feeds.example.org/"), "id").alias("url"), category.alias("category"),
            _kind(F.col("id")).alias("content_kind"), (F.col("id") % 5 != 0).alias("enabled"), F.when(F.col("id") % 7 == 0, "timeout").otherwise("").alias("refresh_error"),
        )

    @property
    def entries(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", "quality", "toxic")
        d = self.table("documents").join(labels, "doc_id", "left")
        id_, source = F.col("doc_id"), F.substring("source", 4, 9).cast("long")
        url = F.concat(F.lit("https://example.org/a/"), id_)
        status = F.when(F.col("quality").isNull(), "unread").when((F.col("quality") == 1) & (F.col("toxic") == 0), "kept").otherwise("discarded")
        return d.select(
            id_.alias("id"), source.alias("source_id"), F.concat(F.lit("g"), id_).alias("guid"), url.alias("url"), url.alias("canonical_url"),
            F.when(id_ % 2 == 0, F.concat(F.lit("doi:10.1000/"), id_)).alias("canonical_key"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.lit("").alias("author"),
            F.when(id_ % 5 != 0, F.concat(F.lit("2024-"), _two(id_ % 12), F.lit("-"), _two(id_ % 28), F.lit("T00:00:00+00:00"))).alias("published_at"),
            F.concat(F.lit("2025-01-"), _two(id_ % 28), F.lit("T00:00:00+00:00")).alias("discovered_at"), F.col("text").alias("content"), F.lit("").alias("summary"),
            _kind(source).alias("content_kind"), status.alias("status"), F.when(id_ % 9 == 0, "enriched").otherwise("pending").alias("enrichment_state"),
        )

    @property
    def rankings(self) -> DataFrame:
        e = self.entries.where("id % 3 <> 0").select(F.col("id").alias("entry_id"), _profile(F.col("content_kind")).alias("profile_id"), ((F.col("id") * 37 % 1000) / 10).alias("score"))
        return e.withColumn("bucket", F.when(F.col("score") >= 60, "relevant").otherwise("filtered"))

    @property
    def profiles(self) -> DataFrame:
        return self.spark.createDataFrame([(1, "paper"), (2, "news")], "id long, content_kind string")

    @property
    def feedback(self) -> DataFrame:
        e = self.entries.where("status in ('kept', 'discarded')")
        return e.select(F.col("id").alias("entry_id"), _profile(F.col("content_kind")).alias("profile_id"), F.when(F.col("status") == "kept", "keep").otherwise("discard").alias("label"), F.concat(F.lit("2025-02-"), _two(F.col("id") % 28), F.lit("T00:00:00+00:00")).alias("updated_at"))

    @property
    def identifiers(self) -> DataFrame:
        return self.entries.where("id % 2 = 0").select(F.col("id").alias("entry_id"), F.lit("doi").alias("scheme"), F.concat(F.lit("10.1000/"), "id").alias("value"), F.lit(1).alias("is_primary"))

    @property
    def references(self) -> DataFrame:
        i, k = F.col("citing_entry_id"), F.col("k")
        rows = self.entries.select(F.col("id").alias("citing_entry_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
        return rows.select(
            (i * 3 + k).alias("id"), "citing_entry_id", F.when(k == 3, i * 11 % 500).alias("cited_entry_id"), F.when(k == 2, "url").otherwise("doi").alias("scheme"),
            F.when(k == 1, F.concat(F.lit("10.1000/"), i * 7 % 2000)).otherwise("").alias("value"), F.when(k == 2, F.concat(F.lit("https://example.org/a/"), i * 13 % 2000)).otherwise("").alias("url"),
            F.concat(F.lit("Work "), i * k % 97).alias("title"), F.when(i % 5 != 0, k).alias("position"),
        )

    @property
    def exports(self) -> DataFrame:
        return self.entries.where("status = 'kept' and id % 4 <> 0").select(F.col("id").alias("entry_id"), F.when(F.col("id") % 6 == 1, "failed").otherwise("synced").alias("state"), F.concat(F.lit("Papers/"), "id", F.lit(".md")).alias("path"))


def _two(n) -> F.Column:
    return F.lpad((n + 1).cast("string"), 2, "0")


def _kind(source) -> F.Column:
    return F.when(source % 2 == 0, "paper").otherwise("news")


def _profile(kind) -> F.Column:
    return F.when(kind == "paper", F.lit(1)).otherwise(F.lit(2)).cast("long")


SQL = """WITH sources AS (
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id FROM documents
), src AS (
  SELECT id, 'Feed ' || id AS title, 'https://feeds.example.org/' || id AS url, (['Systems', 'learning', 'Hardware', 'Unsorted'])[CAST(id % 4 + 1 AS INTEGER)] AS category,
    CASE WHEN id % 2 = 0 THEN 'paper' ELSE 'news' END AS content_kind, id % 5 <> 0 AS enabled, CASE WHEN id % 7 = 0 THEN 'timeout' ELSE '' END AS refresh_error FROM sources
), entries AS (
  SELECT d.doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, 'g' || d.doc_id AS guid, 'https://example.org/a/' || d.doc_id AS url, 'https://example.org/a/' || d.doc_id AS canonical_url,
    CASE WHEN d.doc_id % 2 = 0 THEN 'doi:10.1000/' || d.doc_id END AS canonical_key, substr(split_part(text, chr(10), 1), 1, 80) AS title, '' AS author,
    CASE WHEN d.doc_id % 5 <> 0 THEN '2024-' || lpad(CAST(d.doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00+00:00' END AS published_at,
    '2025-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00+00:00' AS discovered_at, text AS content, '' AS summary,
    CASE WHEN CAST(substr(source, 4) AS BIGINT) % 2 = 0 THEN 'paper' ELSE 'news' END AS content_kind,
    CASE WHEN quality IS NULL THEN 'unread' WHEN quality = 1 AND toxic = 0 THEN 'kept' ELSE 'discarded' END AS status, CASE WHEN d.doc_id % 9 = 0 THEN 'enriched' ELSE 'pending' END AS enrichment_state
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), es AS (
  SELECT e.*, s.title AS source_title, s.category FROM entries e JOIN src s ON s.id = e.source_id
), rankings AS (
  SELECT id AS entry_id, CAST(CASE WHEN content_kind = 'paper' THEN 1 ELSE 2 END AS BIGINT) AS profile_id, (id * 37 % 1000) / 10.0 AS score, CASE WHEN (id * 37 % 1000) / 10.0 >= 60 THEN 'relevant' ELSE 'filtered' END AS bucket FROM entries WHERE id % 3 <> 0
), profiles AS (
  SELECT CAST(1 AS BIGINT) AS id, 'paper' AS content_kind UNION ALL SELECT 2, 'news'
), feedback AS (
  SELECT id AS entry_id, CAST(CASE WHEN content_kind = 'paper' THEN 1 ELSE 2 END AS BIGINT) AS profile_id, CASE WHEN status = 'kept' THEN 'keep' ELSE 'discard' END AS label, '2025-02-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00+00:00' AS updated_at
  FROM entries WHERE status IN ('kept', 'discarded')
), identifiers AS (
  SELECT id AS entry_id, 'doi' AS scheme, '10.1000/' || id AS value, 1 AS is_primary FROM entries WHERE id % 2 = 0
), refs AS (
  SELECT e.id * 3 + k AS id, e.id AS citing_entry_id, CASE WHEN k = 3 THEN e.id * 11 % 500 END AS cited_entry_id, CASE WHEN k = 2 THEN 'url' ELSE 'doi' END AS scheme,
    CASE WHEN k = 1 THEN '10.1000/' || (e.id * 7 % 2000) ELSE '' END AS value, CASE WHEN k = 2 THEN 'https://example.org/a/' || (e.id * 13 % 2000) ELSE '' END AS url,
    'Work ' || (e.id * k % 97) AS title, CASE WHEN e.id % 5 <> 0 THEN k END AS position
  FROM entries e, (SELECT unnest([1, 2, 3]) AS k)
), exports AS (
  SELECT id AS entry_id, CASE WHEN id % 6 = 1 THEN 'failed' ELSE 'synced' END AS state, 'Papers/' || id || '.md' AS path FROM entries WHERE status = 'kept' AND id % 4 <> 0
)
"""
