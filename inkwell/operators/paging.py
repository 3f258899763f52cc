"""Ordered lists: newest first, ranked, pages with cursors, and the small fixed orders."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.filters import after, sort_key


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.withColumn("sort_key", sort_key()).orderBy(F.desc("sort_key"), F.desc("id"))


def ranked(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("score"), F.desc("id"))


def encode_cursor(value: object, id_: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, id_], ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[object, int]:
    try:
        value, id_ = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as error:
        raise ValueError("invalid cursor") from error
    if isinstance(id_, bool) or not isinstance(id_, int):
        raise ValueError("invalid cursor")
    return value, id_


def page(entries: DataFrame, limit: int, cursor: str | None = None, by_score: bool = False) -> tuple[list, str | None]:
    """One page and the next page's cursor (None at the end). Sorting is a distributed top-n, not a full sort."""
    if limit < 1:
        raise ValueError("limit must be positive")
    key = F.col("score") if by_score else sort_key()
    rows = entries.withColumn("sort_key", key)
    if cursor is not None:
        rows = rows.where(after(F.col("sort_key"), *decode_cursor(cursor)))
    found = rows.orderBy(F.desc("sort_key"), F.desc("id")).limit(limit + 1).collect()
    more = len(found) > limit
    found = found[:limit]
    return found, encode_cursor(found[-1]["sort_key"], found[-1]["id"]) if more else None


def page_after(entries: DataFrame, column, value: object, id_: int, limit: int) -> DataFrame:
    rows = entries.withColumn("sort_key", column)
    return rows.where(after(F.col("sort_key"), value, id_)).orderBy(F.desc("sort_key"), F.desc("id")).limit(limit)


def recent_feedback(feedback: DataFrame, profile_id: int, limit: int = 200) -> DataFrame:
    return feedback.where(F.col("profile_id") == profile_id).orderBy(F.desc("updated_at"), F.desc("entry_id")).limit(limit)


def citation_order(references: DataFrame) -> DataFrame:
    return references.orderBy(F.asc_nulls_last("position"), "id")


def identifier_order(identifiers: DataFrame) -> DataFrame:
    return identifiers.orderBy(F.desc("is_primary"), "scheme", "value")


def keyword_order(keywords: DataFrame) -> DataFrame:
    return keywords.orderBy("kind", F.desc_nulls_last("score"), "keyword")


def manifest_order(sources: DataFrame) -> DataFrame:
    return sources.orderBy("content_kind", F.lower("category"), F.lower("title"), "url")


def profile_order(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("content_kind")


def export_order(exports: DataFrame) -> DataFrame:
    return exports.orderBy("entry_id")


def archive_order(archives: DataFrame, entry_id: int) -> DataFrame:
    """An entry's archives, latest first."""
    return archives.where(F.col("entry_id") == entry_id).orderBy(F.desc("archived_at"), F.desc("id"))
