"""Incremental ingestion: a file stream of landed feed documents, merged into the entries table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import text as tx
from inkwell.operators import filters, joins, merge
from inkwell.schema import ENTRIES, SKIPS, migrated

LANDED = T.StructType([T.StructField(n, T.LongType() if n == "source_id" else T.StringType()) for n in "source_id guid url canonical_url title author published_at content content_kind arrived".split()])


def as_entries(items: DataFrame, now: str) -> DataFrame:
    """Items as new entry rows with an extractive summary."""
    rows = items.withColumn("summary", tx.summary(F.col("title"), F.col("content"))).withColumn("summary_provider", F.lit("extractive"))
    rows = rows.withColumn("discovered_at", F.lit(now)).withColumn("updated_at", F.lit(now)).withColumn("summary_generated_at", F.lit(now)).withColumn("status", F.lit("unread"))
    return migrated(rows, ENTRIES)


def merge_batch(entries: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """The entries after one batch: of items that share (source, guid) or an address the last to arrive counts, known
    entries are updated by the upsert rules, others get new ids in a total order."""
    own = joins.first_by(items, ["source_id", "guid"], [F.desc("arrived"), F.desc("title")])
    address = F.when(F.coalesce("canonical_url", F.lit("")) != "", F.col("canonical_url")).otherwise(F.concat_ws("\x1f", F.col("source_id").cast("string"), "guid"))
    own = joins.first_by(own.withColumn("_a", address), ["_a"], [F.desc("arrived"), F.desc("source_id"), F.desc("guid")]).drop("_a")
    own = own.withColumn("item", F.concat_ws("\x1f", F.col("source_id").cast("string"), "guid"))
    known = merge.matched_ids(own, entries)
    rows = own.join(known, "item", "left")
    update = joins.first_by(rows.where("entry is not null"), ["entry"], [F.desc("arrived"), F.desc("item")])
    changed = as_entries(update, now).drop("id").join(update.select("source_id", "guid", F.col("entry").alias("id")), ["source_id", "guid"])
    out = merge.upsert(entries, changed.select(*(c for c in ENTRIES.names)).drop("source_id", "guid"), ["id"], merge.ENTRY_RULES)
    new = as_entries(rows.where("entry is null").drop("entry", "item"), now).drop("id")
    last = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    numbered = merge.with_ids(new, last + 1, ["discovered_at", "source_id", "guid"])
    return out.select(ENTRIES.names).unionByName(numbered.select(ENTRIES.names))


def run(spark: SparkSession, landing: str, table: str, checkpoint: str, now: str, timeout: int = 300) -> None:
    """Merges everything that has landed since the last run, then stops. A repeated batch changes nothing: the merge is by key."""
    stream = spark.readStream.schema(LANDED).json(landing)

    def each(batch: DataFrame, _: int) -> None:
        try:
            entries = migrated(batch.sparkSession.read.parquet(table), ENTRIES)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            entries = batch.sparkSession.createDataFrame([], ENTRIES)
        merge.swapped(merge_batch(entries, batch, now), table)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("ingestion did not end in time")
    finally:
        query.stop()


def skip_state(items: DataFrame, skips: DataFrame, first_runs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(admitted items, new skip list): what a news source's first run leaves out is never admitted later."""
    marked = items.join(first_runs.select("source_id", F.lit(True).alias("_first")).distinct(), "source_id", "left")
    first = F.coalesce("_first", F.lit(False))
    taken = filters.admitted(marked, skips, first, now)
    left = marked.where(first & (F.col("kind") == "news")).join(taken.select("source_id", "guid"), ["source_id", "guid"], "left_anti")
    grown = merge.insert_ignore(skips.select(SKIPS.names), left.select(SKIPS.names), SKIPS.names)
    return taken.select(items.columns), grown


def triage_state(events: DataFrame) -> DataFrame:
    """The last event of each (user, kind) of a log, by time then id: what a changed status leaves."""
    return merge.latest(events, ["user_id", "event_type"], ["ts", "event_id"])
