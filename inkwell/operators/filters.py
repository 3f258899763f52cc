"""Filters over entries: optional predicates that hold together, keyset pages, lookups and phrase rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import ascii_lower, matching_phrases, strip
from inkwell.schema import KINDS, STATUSES

SEARCHED = ("title", "author", "summary", "content", "source_title", "category")


@dataclass(frozen=True)
class EntryFilter:
    status: str | None = None
    category: str | None = None
    kind: str | None = None
    query: str | None = None
    bucket: str | None = None


def sort_key() -> Column:
    """What lists are ordered by: the published date as text, else when the entry was found."""
    return F.coalesce("published_at", "discovered_at")


def search(df: DataFrame, query: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows with the pattern in any column: case counts only outside ASCII, % and _ are wildcards, nothing escapes them."""
    text = query.strip()
    if not text:
        return df
    pattern = "%" + "".join(c.lower() if c.isascii() else c for c in text).replace("\\", "\\\\") + "%"
    found = F.lit(False)
    for c in columns:
        if c in df.columns:
            found = found | F.coalesce(ascii_lower(F.col(c)).like(pattern), F.lit(False))
    return df.where(found)


def matching(entries: DataFrame, wanted: EntryFilter, rankings: DataFrame | None = None) -> DataFrame:
    """All given predicates hold; ``entries`` is joined with its sources. A bucket needs any profile's ranking in it."""
    if wanted.status is not None and wanted.status not in STATUSES:
        raise ValueError(f"unknown status: {wanted.status}")
    if wanted.kind is not None and wanted.kind not in KINDS:
        raise ValueError(f"unknown kind: {wanted.kind}")
    for column, value in (("status", wanted.status), ("category", wanted.category), ("content_kind", wanted.kind)):
        if value is not None:
            entries = entries.where(F.col(column) == value)
    if wanted.query:
        entries = search(entries, wanted.query)
    if wanted.bucket is not None:
        entries = entries.join(rankings.where(F.col("bucket") == wanted.bucket).select(F.col("entry_id").alias("id")), "id", "left_semi")
    return entries


def after(column: Column, value: object, id_: int) -> Column:
    """The keyset predicate of a descending list: strictly behind (value, id)."""
    return (column < F.lit(value)) | ((column == F.lit(value)) & (F.col("id") < id_))


def by_canonical_key(entries: DataFrame, key: str) -> DataFrame:
    return _first(entries.where(F.lower("canonical_key") == key.strip().lower()))


def by_url(entries: DataFrame, url: str) -> DataFrame:
    """The smallest entry of that address; two equality scans instead of one disjunction."""
    return _first(entries.where(F.col("url") == url).unionByName(entries.where(F.col("canonical_url") == url)))


def by_identifier(entries: DataFrame, identifiers: DataFrame, scheme: str, value: str) -> DataFrame:
    v = value.strip().lower() if scheme.strip().lower() in ("doi", "arxiv", "s2") else value.strip()
    ids = identifiers.where((F.col("scheme") == scheme.strip().lower()) & (F.col("value") == v)).select(F.col("entry_id").alias("id"))
    return entries.join(ids, "id", "left_semi")


def _first(df: DataFrame) -> DataFrame:
    return df.orderBy("id").limit(1)


def fresh(cache: DataFrame, now: Column, max_age: str) -> DataFrame:
    """Cache rows that are young enough and hold a JSON object."""
    at = F.try_to_timestamp(F.col("fetched_at"))
    return cache.where(at.isNotNull() & (at >= now - F.expr(f"INTERVAL {max_age}")) & strip(F.col("payload")).rlike(r"(?s)^\{.*\}$") & F.try_parse_json("payload").isNotNull())


def admitted(items: DataFrame, skips: DataFrame, first_run: Column, now: Column, days: int = 30) -> DataFrame:
    """Feed items to take in: all papers; news of the last days on a source's first run, later all that aren't skipped.

    ``items`` has source_id, guid, kind and published (timestamp or null)."""
    recent = F.col("published") >= now - F.expr(f"INTERVAL {days} DAYS")
    marked = items.join(skips.select("source_id", "guid", F.lit(True).alias("skipped")).distinct(), ["source_id", "guid"], "left")
    keep = (F.col("kind") == "paper") | F.when(first_run, F.coalesce(recent, F.lit(False))).otherwise(F.col("skipped").isNull())
    return marked.where(keep).select(items.columns)


def never_show(df: DataFrame, text: Column, phrases: list[str]) -> DataFrame:
    return df.withColumn("blocked", matching_phrases(text, phrases))


def health(sources: DataFrame) -> DataFrame:
    """(content_kind, n, failing) of each kind's sources."""
    return sources.groupBy("content_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("refresh_error") != "").alias("failing"))


def enrichment_candidates(entries: DataFrame, located: Column) -> DataFrame:
    """Papers not enriched yet whose address is a locator."""
    return entries.where((F.col("content_kind") == "paper") & (F.col("enrichment_state") != "enriched") & located.isNotNull())
