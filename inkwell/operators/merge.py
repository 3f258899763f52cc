"""Keyed merges: upserts with fill-only rules, latest rows, insert-if-absent, replacement and the tally of an import.

Parquet tables have no MERGE, so each merge is a join that yields the new table; ``swapped`` writes it beside the old one
and renames it into place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_s"))
    return best.select(*keys, *(F.col(f"_s.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """A full outer join by ``keys`` (one new row each). Rules by column: 'new' takes the new value even if blank, 'fill'
    keeps a value that isn't blank, 'if_any' takes a new value that isn't blank, 'coalesce' one that isn't null, 'max' the
    greater, 'old' keeps; rows on one side only pass as they are."""
    n = new.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys))
    o = old.withColumn("_old", F.lit(True))
    rows = o.join(n, keys, "full_outer")
    out = [F.col(k) for k in keys]
    for c in (c for c in old.columns if c not in keys):
        if c not in new.columns:
            out.append(F.col(c))
            continue
        a, b = F.col(c), F.col(f"_n_{c}")
        both = {"new": b, "fill": F.when(_some(a.cast("string")), a).otherwise(b), "if_any": F.when(_some(b.cast("string")), b).otherwise(a), "coalesce": F.coalesce(b, a), "max": F.greatest(a, b), "old": a}[rules.get(c, "new")]
        out.append(F.when(F.col("_old").isNull(), b).when(F.col("_new").isNull(), a).otherwise(both).alias(c))
    return rows.select(*out)


#: How an entry's columns take a repeated item: text is only filled in, never blanked; triage is never touched.
ENTRY_RULES = {
    "url": "new", "title": "new", "author": "new", "published_at": "new", "canonical_url": "new", "content_kind": "new", "updated_at": "new",
    "content": "if_any", "content_markdown": "if_any", "summary": "fill", "summary_provider": "fill", "summary_model": "fill", "summary_generated_at": "fill",
    "canonical_key": "coalesce", "status": "old", "discovered_at": "old", "id": "old", "exported_path": "old",
}


def matched_ids(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(item, entry): the entry that an item means: by (source, guid), else by address or canonical address (smallest id).

    Three equality joins instead of one disjunction; the best match by priority comes from a partial aggregation."""
    addressed = entries.select("id", "source_id", "guid", "url", "canonical_url")
    one = items.join(addressed.select("source_id", "guid", "id"), ["source_id", "guid"]).select("item", F.lit(0).alias("p"), "id")
    two = items.where(_some(F.col("url"))).select("item", "url").join(addressed.select("url", "id"), "url").select("item", F.lit(1).alias("p"), "id")
    three = items.where(_some(F.col("canonical_url"))).select("item", "canonical_url").join(addressed.select("canonical_url", "id"), "canonical_url").select("item", F.lit(1).alias("p"), "id")
    best = one.unionByName(two).unionByName(three).groupBy("item").agg(F.min(F.struct("p", "id")).alias("m"))
    return best.select("item", F.col("m.id").alias("entry"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def replace_for(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fill_metadata(entries: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """Blank columns take the found values; others stay."""
    f = found.select("id", *(F.col(c).alias(f"_f_{c}") for c in columns))
    rows = entries.join(f, "id", "left")
    return rows.select(*(F.when(_some(F.col(c).cast("string")), F.col(c)).otherwise(F.coalesce(F.col(f"_f_{c}"), F.col(c))).alias(c) if c in columns else F.col(c) for c in entries.columns))


#: ``with_ids`` deals rows to GROUPS * GROUPS ranges of keys, bounded by a sample of SAMPLE keys for each range.
GROUPS, SAMPLE = 12, 20


def with_ids(rows: DataFrame, first: int, order: list[str]) -> DataFrame:
    """Rows numbered from ``first`` by a total order, without one task that sorts all: each range of keys is counted (one
    number per range goes to the driver) and numbered from its offset.

    The ranges' bounds are constants of the plan, so an id depends on the rows alone and every run of the plan gives the
    same ids. (Spark's own range partitions come from a new sample in each run, and may be merged in one and not in another.)"""
    key = F.struct(*order)
    keys = rows.select(key.alias("k"))
    types = [f.dataType for f in keys.schema["k"].dataType]
    sample = keys.orderBy(F.xxhash64("k")).limit(GROUPS * GROUPS * SAMPLE).orderBy("k").collect()
    ranges = [sample[len(sample) * i // GROUPS**2].k for i in range(GROUPS**2)] if sample else []
    bounds = [F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(k, types, order))) for k in ranges]
    if not bounds:
        return rows.select(F.lit(first).cast("long").alias("id"), *rows.columns)
    below = lambda found: F.size(F.filter(found, lambda b: b <= key))
    group = F.greatest(below(F.array(*bounds[::GROUPS])) - 1, F.lit(0))  # two short searches, not one through all bounds
    own = F.get(F.array(*(F.array(*bounds[at : at + GROUPS]) for at in range(0, GROUPS**2, GROUPS))), F.col("_g"))
    dealt = rows.withColumn("_g", group).withColumn("_p", F.col("_g") * GROUPS + below(own))
    sizes = dict(dealt.groupBy("_p").count().collect())
    offsets, at = [F.lit(0).cast("long")] * (GROUPS**2 + 1), first
    for p in sorted(sizes):
        offsets[p] = F.lit(at).cast("long")
        at += sizes[p]
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_n", rank).select((F.get(F.array(*offsets), F.col("_p")) + F.col("_n") - 1).alias("id"), *rows.columns)


def tally(actions: DataFrame) -> DataFrame:
    return actions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "unchanged")))


def one_primary(identifiers: DataFrame) -> DataFrame:
    """At most one primary identifier per entry: the first by scheme and value among the marked."""
    w = Window.partitionBy("entry_id").orderBy(F.desc("is_primary"), "scheme", "value")
    return identifiers.withColumn("_r", F.row_number().over(w)).withColumn("is_primary", F.when((F.col("_r") == 1) & (F.col("is_primary") == 1), 1).otherwise(0)).drop("_r")


def swapped(df: DataFrame, path: str) -> None:
    """Writes the table beside ``path`` and renames it into place, so that readers see the old or the new one whole."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(conf)
    had = fs.exists(to(path))
    if had and not fs.rename(to(path), to(old)):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(to(new), to(path)):
        if had:
            fs.rename(to(old), to(path))
        raise OSError(f"can't move {new} into place")
    if had:
        fs.delete(to(old), True)
