"""Jobs over the whole collection, composed of operators: refresh, seed, backfill, import of papers, triage, rescoring, export.

Network access and models are injected callables; without them everything here runs offline.
"""

from __future__ import annotations

import json
import shutil
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import ids, keywords
from inkwell.functions import text as tx
from inkwell.operators import filters, joins, merge
from inkwell.schema import IDENTIFIERS, KEYWORDS, STATUSES
from inkwell.sources import feeds, manifest, notes
from inkwell.streaming import ingest

MAX_FEED = 10 << 20


@dataclass(frozen=True)
class Response:
    """What a conditional request gives: no document if nothing changed."""

    document: bytes | None = None
    etag: str | None = None
    last_modified: str | None = None


Fetch = Callable[[str, str | None, str | None], Response]


def fetched(sources: DataFrame, fetch: Fetch) -> DataFrame:
    """(source_id, document, etag, last_modified, error): one request for each enabled source, in parallel by partition; a
    failing source gives an error row and stops no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    got = fetch(r.url, r.etag, r.last_modified)
                    if got.document is not None and len(got.document) > MAX_FEED:
                        raise ValueError("the feed is too large")
                    rows.append((r.id, got.document, got.etag, got.last_modified, ""))
                except Exception as error:  # isolated by source
                    rows.append((r.id, None, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["source_id", "document", "etag", "last_modified", "error"])

    asked = sources.where("enabled").select("id", "url", "etag", "last_modified")
    return asked.mapInPandas(run, "source_id long, document binary, etag string, last_modified string, error string")


def refreshed_sources(sources: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Sources after a refresh: success clears the error and keeps validators that the answer lacks, a failure is noted."""
    r = results.select(F.col("source_id").alias("id"), F.col("etag").alias("_e"), F.col("last_modified").alias("_m"), F.col("error").alias("_x"))
    rows = sources.join(r, "id", "left")
    fine = F.col("_x") == ""
    changed = {
        "refresh_error": F.when(F.col("_x").isNull(), F.col("refresh_error")).otherwise(F.col("_x")),
        "etag": F.when(fine, F.coalesce("_e", "etag")).otherwise(F.col("etag")),
        "last_modified": F.when(fine, F.coalesce("_m", "last_modified")).otherwise(F.col("last_modified")),
        "refreshed_at": F.when(fine, F.lit(now)).otherwise(F.col("refreshed_at")),
    }
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in sources.columns))


Store = Callable[[DataFrame, str], DataFrame]


def refresh(sources: DataFrame, entries: DataFrame, skips: DataFrame, results: DataFrame, now: str, store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, skips, sources) after the fetched documents are merged. ``store`` writes a table under a name and gives it
    back: requests and parsed items are read often and must not be made again."""
    results = store(results, "results")
    documents = results.where("document is not null").select("source_id", "document")
    kinds = sources.select(F.col("id").alias("source_id"), F.col("content_kind").alias("kind"), F.col("refreshed_at").isNull().alias("first"))
    items = store(feeds.read_items(documents).join(kinds, "source_id").withColumn("published", F.try_to_timestamp("published_at")), "items")
    first = items.where("first").select("source_id").distinct()
    taken, grown = ingest.skip_state(items, skips, first, F.lit(now).cast("timestamp"))
    landed = taken.select("source_id", "guid", "url", F.col("url").alias("canonical_url"), "title", "author", "published_at", "content", F.col("kind").alias("content_kind"), F.concat(F.lit(now), F.lpad(F.col("position").cast("string"), 9, "0")).alias("arrived"))
    known = results.join(feeds.read_errors(documents).withColumnRenamed("error", "_bad"), "source_id", "left").withColumn("error", F.coalesce("_bad", "error")).drop("_bad")
    return store(ingest.merge_batch(entries, store(landed, "landed"), now), "entries"), store(grown, "skips"), store(refreshed_sources(sources, known, now), "sources")


def seed(spark: SparkSession, sources: DataFrame, document: str = manifest.SEED) -> DataFrame:
    """The catalogue's sources that aren't known yet, by address."""
    return manifest.validated(spark, document).drop("position").join(sources.select("url"), "url", "left_anti")


def backfill(entries: DataFrame, identifiers: DataFrame, references: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """What old rows lack: identifiers and keys of papers from addresses, keywords of entries without any, targets of citations. Idempotent."""
    found = entries.where("content_kind = 'paper'").select(F.col("id").alias("entry_id"), ids.derived_identifier(F.coalesce("canonical_url", "url")).alias("x")).where("x is not null")
    found = found.select("entry_id", "x.scheme", "x.value", F.lit(0).alias("is_primary"))
    grown = merge.insert_ignore(identifiers.select(IDENTIFIERS.names), joins.first_by(found, ["scheme", "value"], ["entry_id"]).select(IDENTIFIERS.names), ["scheme", "value"])
    wide = grown.groupBy("entry_id").agg(*(F.min(F.when(F.col("scheme") == s, F.col("value"))).alias(s) for s in ("doi", "arxiv", "s2")))
    keyed = entries.join(wide.withColumnRenamed("entry_id", "id"), "id", "left")
    key = F.coalesce(F.nullif("canonical_key", F.lit("")), ids.identity(F.col("doi"), F.col("arxiv"), F.col("s2"), F.lit(None).cast("string")))
    keyed = keyed.withColumn("canonical_key", key).select(entries.columns)
    bare = entries.join(known.select(F.col("entry_id").alias("id")).distinct(), "id", "left_anti")
    words = keywords.extract(bare, "id", "title", "content").select(F.col("id").alias("entry_id"), F.lit("keyword").alias("kind"), "keyword", "score", F.lit("frequency").alias("provider"))
    return {"identifiers": grown, "entries": keyed, "keywords": known.select(KEYWORDS.names).unionByName(words.select(KEYWORDS.names)), "references": joins.reconciled(references, grown, keyed)}


def works_to_entries(works: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(work_id, entry_id or null) of imported works (work_id, doi, arxiv, s2); identifiers of different entries are an error."""
    each = works.select("work_id", F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(s).alias("value")) for s in ("doi", "arxiv", "s2")))).alias("x")).select("work_id", "x.*").where("value is not null")
    met = each.join(identifiers.select("scheme", "value", "entry_id"), ["scheme", "value"])
    bad = joins.ambiguous(met).first()
    if bad is not None:
        raise ValueError(f"work {bad.work_id} has identifiers of several entries")
    return works.select("work_id").join(met.select("work_id", "entry_id").distinct(), "work_id", "left")


def new_references(works: DataFrame, entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Edges of works (entry_id, refs): key, scheme, value, title, position, and the target by identifier, else by address."""
    rows = works.select(F.col("entry_id").alias("citing_entry_id"), F.posexplode("refs").alias("position", "r")).select("citing_entry_id", (F.col("position") + 1).alias("position"), "r.*")
    rows = rows.withColumn("reference_key", F.concat_ws(":", "scheme", "value")).dropDuplicates(["citing_entry_id", "reference_key"])
    rows = rows.withColumn("id", F.xxhash64("citing_entry_id", "reference_key")).withColumn("cited_entry_id", F.lit(None).cast("long"))
    return joins.reconciled(rows, identifiers, entries)


def changed_status(entries: DataFrame, feedback: DataFrame, changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(entries, feedback) after (id, status) changes: keep and discard leave a label, unread and read clear it."""
    bad = changes.where(~F.col("status").isin(*STATUSES)).first()
    if bad is not None:
        raise ValueError(f"unknown status: {bad.status}")
    c = changes.select("id", F.col("status").alias("_s"))
    rows = entries.join(c, "id", "left").withColumn("updated_at", F.when(F.col("_s").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_s", "status"))
    marks = changes.join(entries.select("id", "content_kind"), "id")
    marks = marks.select(F.col("id").alias("entry_id"), F.when(F.col("content_kind") == "paper", 1).otherwise(2).cast("long").alias("profile_id"), F.when(F.col("status") == "kept", "keep").when(F.col("status") == "discarded", "discard").alias("label"), F.lit(now).alias("updated_at"))
    left = feedback.join(marks.select("entry_id"), "entry_id", "left_anti").select("entry_id", "profile_id", "label", "updated_at")
    return rows.select(entries.columns), left.unionByName(marks.where("label is not null"))


def reasons(matched: Column, labels: dict[str, Column], most: int = 3) -> Column:
    """Up to ``most`` distinct reasons why an entry ranks as it does: matched interests, then named parts that are positive."""
    parts = [F.transform(matched, lambda m: F.concat(F.lit("interest: "), m))]
    parts += [F.when(value > 0, F.array(F.lit(said))).otherwise(F.array().cast("array<string>")) for said, value in labels.items()]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


def page_filter(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """The narrower search within a page already fetched: a plain substring, case ignored."""
    text = F.lower(F.concat_ws(" ", *columns))
    return df.where(text.contains(query.strip().lower())) if query.strip() else df


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row (column ``json``), nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def enrichable(entries: DataFrame) -> DataFrame:
    return filters.enrichment_candidates(entries, ids.locator(F.col("url")))


class Coordinator:
    """One running job per kind; requests that come meanwhile make it run once more."""

    def __init__(self, job: Callable[[str], None]) -> None:
        self.job, self.lock, self.state, self.errors = job, threading.Lock(), {}, {}

    def request(self, kind: str) -> bool:
        """Runs the job here, or leaves the request to the one that runs it; whether it ran here."""
        with self.lock:
            if kind in self.state:
                self.state[kind] = True
                return False
            self.state[kind] = False
        while True:
            try:
                self.job(kind)
                self.errors.pop(kind, None)
            except Exception as error:
                self.errors[kind] = str(error)
            with self.lock:
                if not self.state[kind]:
                    del self.state[kind]
                    return True
                self.state[kind] = False

    def health(self) -> dict:
        with self.lock:
            return {"running": sorted(self.state), "errors": dict(self.errors)}


def exported(rows: DataFrame, existing: DataFrame, root: str) -> DataFrame:
    """Writes the notes that merge without conflict; (entry_id, path, state) of all. ``existing`` has path and old text."""
    m = notes.rendered(rows).join(existing.select("path", F.col("text").alias("_old")), "path", "left")
    m = m.withColumn("_m", notes.merged("_old", "properties", "body", "text"))
    state = m.select(F.col("id").alias("entry_id"), "path", F.when(F.col("_m.conflict").isNull(), "synced").otherwise("conflict").alias("state"), F.col("_m.text").alias("text"))
    notes.write(state.where("state = 'synced'"), root)
    return state.drop("text")


def archive(root: str, path: str, stamp: str) -> str:
    """Moves a note into the archive under a time stamp; its path there."""
    target = Path(root) / "Archive" / stamp / path
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(Path(root) / path, target)
    return str(target.relative_to(root))


def restore(root: str, archived: str, path: str) -> None:
    """Moves a note back; an existing note is never overwritten."""
    target = Path(root) / path
    if target.exists():
        raise notes.Conflict(f"{path} exists")
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(Path(root) / archived, target)


def demo(spark: SparkSession) -> DataFrame:
    """Two entries to look at."""
    rows = [(1, "demo-1", "https://example.org/demo/1", "Sparse kernels on small chips", "A note on sparse kernels. It has two sentences.", "paper"), (2, "demo-2", "https://example.org/demo/2", "A new accelerator", "News of an accelerator.", "news")]
    return spark.createDataFrame(rows, "id long, guid string, url string, title string, content string, content_kind string").withColumn("summary", tx.summary(F.col("title"), F.col("content")))


def printed(df: DataFrame) -> str:
    """Rows as indented JSON, for a terminal; the caller bounds the rows."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, indent=2, default=str)
