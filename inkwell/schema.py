"""Tables of the collection as explicit schemas, their enumerations, and evolution of older files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the data model.
STATUSES = ("unread", "read", "kept", "discarded")
KINDS = ("paper", "news")
BUCKETS = ("relevant", "filtered")
LABELS = ("keep", "discard")
SELECTIVITIES = ("broad", "balanced", "focused")
EXPORT_STATES = ("synced", "conflict", "failed", "archived")

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "map<string,double>": T.MapType(T.StringType(), T.DoubleType())}


def _struct(columns: str) -> T.StructType:
    """A schema from 'name type, ...', without a session."""
    pairs = (c.strip().split(" ", 1) for c in columns.split(", "))
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


SOURCES = _struct("id long, title string, url string, category string, content_kind string, enabled boolean, refresh_error string, etag string, last_modified string, refreshed_at string")
ENTRIES = _struct(
    "id long, source_id long, guid string, url string, canonical_url string, canonical_key string, title string, author string, published_at string,"
    " discovered_at string, content string, content_markdown string, summary string, summary_provider string, summary_model string, summary_generated_at string,"
    " content_kind string, status string, enrichment_state string, enriched_at string, exported_path string, updated_at string"
)
RANKINGS = _struct("entry_id long, profile_id long, score double, bucket string, components map<string,double>, explanation string, updated_at string")
FEEDBACK = _struct("entry_id long, profile_id long, label string, updated_at string")
IDENTIFIERS = _struct("entry_id long, scheme string, value string, is_primary int")
REFERENCES = _struct("id long, citing_entry_id long, cited_entry_id long, reference_key string, scheme string, value string, title string, url string, position int")
KEYWORDS = _struct("entry_id long, kind string, keyword string, score double, provider string")
SKIPS = _struct("source_id long, guid string")
TABLES = {"sources": SOURCES, "entries": ENTRIES, "rankings": RANKINGS, "feedback": FEEDBACK, "identifiers": IDENTIFIERS, "references": REFERENCES, "keywords": KEYWORDS, "skips": SKIPS}

#: What a column that an older file lacks is filled with; others become null.
DEFAULTS = {"status": "unread", "content_kind": "paper", "category": "Unsorted", "enabled": True, "refresh_error": "", "summary": "", "summary_provider": "", "summary_model": "", "content_markdown": "", "canonical_url": "", "enrichment_state": "pending", "is_primary": 0}


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones are added with their defaults, others dropped."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols)


def checked(column: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The column itself; a row with a value outside ``allowed`` raises an error."""
    return F.when(F.assert_true(column.isin(*allowed), F.concat(F.lit(f"unknown {what}: "), F.coalesce(column, F.lit("null")))).isNull(), column)


def backfilled(entries: DataFrame) -> DataFrame:
    """Idempotent repairs of old rows: canonical address and update time from what is there, no blank enumerations."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        entries.withColumn("canonical_url", F.when(blank("canonical_url"), F.col("url")).otherwise(F.col("canonical_url")))
        .withColumn("updated_at", F.coalesce("updated_at", "discovered_at"))
        .withColumn("status", F.when(blank("status"), F.lit("unread")).otherwise(F.col("status")))
        .withColumn("summary_provider", F.when(~blank("summary") & blank("summary_provider"), F.lit("extractive")).otherwise(F.col("summary_provider")))
    )
