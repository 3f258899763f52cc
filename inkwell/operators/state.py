"""What operations leave behind: summaries, enrichment outcomes, settings, cached vectors, archived notes, backfill counts.

Each function yields the new table; rows of the change that match nothing are ignored unless they are inserts. A change has
one row for each key; all joins are by key, so a table of any size costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import merge

# States that an enrichment can end in, and the longest summary.
ENRICHMENT_STATES = ("pending", "enriched", "failed", "not_applicable")
SUMMARY_LIMIT = 2000


def _with(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def _checked(c: Column, bad: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(message)).cast("string")).otherwise(c)


def _changed(old: DataFrame, changes: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Rows of ``old`` that a change names take ``values``, which read the change's columns as _n_<name>."""
    n = changes.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in changes.columns if c != key))
    rows = old.join(n, key, "left")
    return rows.select(*(F.when(F.col("_new"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns))


def set_summaries(entries: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Entries with the summaries of ``found`` (id, text, provider, model), whatever they held; the time is kept beside."""
    rows = _with(entries, ["summary", "summary_provider", "summary_model", "summary_generated_at", "updated_at"])
    new = {"summary": F.col("_n_text"), "summary_provider": F.col("_n_provider"), "summary_model": F.col("_n_model"), "summary_generated_at": F.lit(now), "updated_at": F.lit(now)}
    return _changed(rows, found.select("id", "text", "provider", "model"), "id", new)


def set_enrichment(entries: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Entries after attempts (id, state, provider, error, canonical_url, canonical_key): enriched_at moves only with
    'enriched', a null address or key keeps the present one, an unknown state is an error."""
    rows = _with(entries, ["enrichment_state", "enrichment_provider", "enrichment_error", "enriched_at", "canonical_url", "canonical_key", "updated_at"])
    state = _checked(F.col("_n_state"), ~F.col("_n_state").isin(*ENRICHMENT_STATES), "unknown enrichment state")
    new = {"enrichment_state": state, "enrichment_provider": F.col("_n_provider"), "enrichment_error": F.col("_n_error"), "updated_at": F.lit(now)}
    new["enriched_at"] = F.when(F.col("_n_state") == "enriched", F.lit(now)).otherwise(F.col("enriched_at"))
    new |= {c: F.coalesce(f"_n_{c}", c) for c in ("canonical_url", "canonical_key")}
    return _changed(rows, outcomes, "id", new)


def summarised(entries: DataFrame, answers: DataFrame, provider: str, model: str) -> DataFrame:
    """(id, text, provider, model, reason): a model's answer (id, generated, error), cut at a word, or the extractive summary
    with the reason why: no text at all, the model's error, an empty answer, or none."""
    rows = entries.select("id", "title", "content").join(answers.select("id", "generated", "error", F.lit(True).alias("asked")), "id", "left")
    empty = (tx.collapse_strip(F.coalesce("content", F.lit(""))) == "") & (tx.collapse_strip(F.coalesce("title", F.lit(""))) == "")
    rows = rows.withColumn("answer", tx.collapse_strip(F.coalesce("generated", F.lit(""))))
    reason = F.when(empty, "empty content").when(F.col("asked").isNull(), "no answer").when(F.col("error").isNotNull(), F.coalesce(F.nullif("error", F.lit("")), F.lit("model error"))).when(F.col("answer") == "", "empty answer")
    rows = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    text = F.when(good, tx.trim_to_word(F.col("answer"), SUMMARY_LIMIT)).otherwise(tx.summary(F.col("title"), F.col("content")))
    return rows.select("id", text.alias("text"), F.when(good, provider).otherwise("fallback").alias("provider"), F.when(good, model).otherwise("").alias("model"), "reason")


def put_settings(settings: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Settings (key, value, updated_at) with those of ``new`` (key, value as JSON); a blank key is an error."""
    key = tx.strip(F.col("key"))
    rows = new.select(_checked(key, key == "", "a setting needs a key").alias("key"), "value", F.lit(now).alias("updated_at"))
    return merge.upsert(settings, rows, ["key"], {})


def get_setting(settings: DataFrame, key: str, schema: str) -> DataFrame:
    """One row (value, parsed by the type ``schema``; a document of another type is an error) or none."""
    whole = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), f"v {schema}", {"mode": "FAILFAST"})
    return settings.where(F.col("key") == key).select(whole["v"].alias("value"))


def put_vectors(cache: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The cache (content_hash, model, dimensions, vector, created_at) with new vectors; blank or empty parts are an error."""
    bad = (F.col("content_hash") == "") | (F.col("model") == "") | (F.col("dimensions") < 1) | (F.length("vector") == 0)
    rows = new.select(_checked(F.col("content_hash"), bad, "a cached vector needs a hash, a model and a vector").alias("content_hash"), "model", "dimensions", "vector", F.lit(now).alias("created_at"))
    return merge.upsert(cache, rows, ["content_hash", "model"], {})


def mark_restored(archives: DataFrame, restored: DataFrame, now: str) -> DataFrame:
    """Archives whose id is in ``restored`` get the time, once: an earlier one stays."""
    return _changed(archives, restored.select("id").distinct(), "id", {"restored_at": F.coalesce("restored_at", F.lit(now))})


def json_list(c: Column) -> Column:
    """A stored JSON list of strings; null gives an empty one, anything that is no list an error."""
    given = F.when(F.trim(c) != "null", c)
    return F.coalesce(F.from_json(given, "array<string>", {"mode": "FAILFAST"}), F.array().cast("array<string>"))


def sorted_json(c: Column) -> Column:
    """A map as JSON with its keys in byte order and the signs of markup escaped; null gives an empty object."""
    out = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"ignoreNullFields": "false"})
    for sign in "&<>\u2028\u2029":
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.coalesce(out, F.lit("{}"))


def backfill_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """One row: entries, and the keys, identifiers, keywords and citation targets that a backfill has added."""
    some = {"entries": F.coalesce("canonical_key", F.lit("")) != "", "references": F.col("cited_entry_id").isNotNull()}
    parts = [t[name].agg(F.count(F.lit(1)).alias("n"), F.count_if(some.get(name, F.lit(True))).alias("k")).select(F.lit(name).alias("name"), F.lit(sign).alias("sign"), "n", "k") for sign, t in ((-1, before), (1, after)) for name in ("entries", "identifiers", "keywords", "references")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    added = lambda name: F.sum(F.when(F.col("name") == name, F.col("sign") * F.col("k")).otherwise(F.lit(0)))
    entries = F.sum(F.when((F.col("name") == "entries") & (F.col("sign") == 1), F.col("n")).otherwise(F.lit(0)))
    return rows.agg(entries.alias("entries"), added("entries").alias("keys_added"), added("identifiers").alias("identifiers_added"), added("keywords").alias("keywords_added"), added("references").alias("references_linked"))
