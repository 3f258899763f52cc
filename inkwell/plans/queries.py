"""The registered queries of the library's own operators, each over its whole tables, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import dates, ids, keywords, url
from inkwell.functions import text as tx
from inkwell.operators import counts, filters, joins, merge, paging, ranking, state
from inkwell.operators.shared import stored
from inkwell.plans.domain import SQL, Domain
from inkwell.schema import KINDS, STATUSES
from inkwell.sources import feeds, markup, notes
from inkwell.streaming import ingest

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the domain's tables under its name, with its SQL over the same tables."""

    def add(f: Callable[[Domain], DataFrame]):
        name = f.__name__
        _FOUND[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            _SQL[name] = SQL + sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Regexes of the SQL statements, in DuckDB's syntax.
_SP = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda t: len(t) > 1 AND t NOT IN ({_STOPS}))"
INTERESTS = ["then on other inter", "die der ung", "la para esta"]
_HEAD = "SELECT id, status, content_kind"


# ---- filters -------------------------------------------------------------------------------------------------


@query(f"{_HEAD} FROM es WHERE status = 'kept'")
def filter_status(d: Domain) -> DataFrame:
    return filters.matching(joins.with_sources(d.entries, d.sources), filters.EntryFilter(status="kept")).select("id", "status", "content_kind")


@query(f"{_HEAD} FROM es WHERE category = 'learning'")
def filter_category(d: Domain) -> DataFrame:
    return filters.matching(joins.with_sources(d.entries, d.sources), filters.EntryFilter(category="learning")).select("id", "status", "content_kind")


@query(f"{_HEAD} FROM es WHERE content_kind = 'news' AND status = 'unread'")
def filter_kind(d: Domain) -> DataFrame:
    return filters.matching(joins.with_sources(d.entries, d.sources), filters.EntryFilter(kind="news", status="unread")).select("id", "status", "content_kind")


@query("SELECT id FROM es WHERE lower(title) LIKE '%the%ing%' OR lower(content) LIKE '%the%ing%' OR lower(source_title) LIKE '%the%ing%' OR lower(category) LIKE '%the%ing%'")
def search_like(d: Domain) -> DataFrame:
    return filters.search(joins.with_sources(d.entries, d.sources), " The%ing ").select("id")


@query("SELECT e.id, r.score FROM entries e JOIN rankings r ON r.entry_id = e.id WHERE r.profile_id = 1 AND r.bucket = 'relevant'")
def bucket_join(d: Domain) -> DataFrame:
    return joins.with_rankings(d.entries, d.rankings, 1).where("bucket = 'relevant'").select("id", "score")


@query("SELECT id FROM es WHERE EXISTS (SELECT 1 FROM rankings r WHERE r.entry_id = es.id AND r.bucket = 'filtered')")
def bucket_exists(d: Domain) -> DataFrame:
    return filters.matching(joins.with_sources(d.entries, d.sources), filters.EntryFilter(bucket="filtered"), d.rankings).select("id")


@query("SELECT id, title, category FROM src WHERE enabled")
def enabled_sources(d: Domain) -> DataFrame:
    return d.sources.where("enabled").select("id", "title", "category").orderBy("category", "title")


@query("SELECT id FROM entries WHERE url = 'https://example.org/a/17' OR canonical_url = 'https://example.org/a/17' ORDER BY id LIMIT 1")
def lookup_url(d: Domain) -> DataFrame:
    return filters.by_url(d.entries, "https://example.org/a/17").select("id")


@query("SELECT id FROM entries WHERE lower(canonical_key) = 'doi:10.1000/18' ORDER BY id LIMIT 1")
def lookup_canonical_key(d: Domain) -> DataFrame:
    return filters.by_canonical_key(d.entries, " DOI:10.1000/18 ").select("id")


@query("SELECT e.id FROM entries e JOIN identifiers i ON i.entry_id = e.id WHERE i.scheme = 'doi' AND i.value = '10.1000/20'")
def lookup_identifier(d: Domain) -> DataFrame:
    return filters.by_identifier(d.entries, d.identifiers, "doi", "10.1000/20").select("id")


def _items(d: Domain) -> DataFrame:
    return d.table("events").select(F.col("user_id").alias("source_id"), F.concat(F.lit("g"), "event_id").alias("guid"), F.when(F.col("user_id") % 2 == 0, "paper").otherwise("news").alias("kind"), F.col("ts").alias("published"))


def _skips(d: Domain) -> DataFrame:
    return _items(d).where("crc32(guid) % 4 = 0").select("source_id", "guid")


_WINDOW = """, now AS (SELECT max(ts) + INTERVAL 15 DAY AS t FROM events), items AS (
  SELECT user_id AS source_id, 'g' || event_id AS guid, CASE WHEN user_id % 2 = 0 THEN 'paper' ELSE 'news' END AS kind, ts FROM events
)
"""


@query(_WINDOW + "SELECT source_id, guid FROM items, now WHERE kind = 'paper' OR ts >= t - INTERVAL 30 DAY")
def bootstrap_window(d: Domain) -> DataFrame:
    items = _items(d)
    now = items.agg(F.max("published") + F.expr("INTERVAL 15 DAYS")).first()[0]  # one value
    empty = items.where("false").select("source_id", "guid")
    return filters.admitted(items, empty, F.lit(True), F.lit(now)).select("source_id", "guid")


@query(_WINDOW + "SELECT source_id, guid FROM items WHERE kind = 'paper' OR CAST(substr(guid, 2) AS BIGINT) % 4 <> 0")
def skip_anti(d: Domain) -> DataFrame:
    skips = _items(d).where("cast(substr(guid, 2) as bigint) % 4 = 0").select("source_id", "guid")
    return filters.admitted(_items(d), skips, F.lit(False), F.lit("2020-01-01").cast("timestamp")).select("source_id", "guid")


@query("SELECT id, list_filter(['the', 'Una', 'zqx'], lambda p: contains(lower(content), lower(p))) AS matched FROM entries")
def phrase_match(d: Domain) -> DataFrame:
    return d.entries.select("id", tx.matching_phrases(F.col("content"), ["the", "Una", "zqx"]).alias("matched"))


@query("SELECT content_kind, count(*) AS n, CAST(count_if(refresh_error <> '') AS BIGINT) AS failing FROM src GROUP BY content_kind")
def source_health(d: Domain) -> DataFrame:
    return filters.health(d.sources)


@query("SELECT id FROM entries WHERE content_kind = 'paper' AND enrichment_state <> 'enriched' AND canonical_key IS NOT NULL")
def enrichment_candidates(d: Domain) -> DataFrame:
    return filters.enrichment_candidates(d.entries, ids.locator(F.substring("canonical_key", 5, 99))).select("id")


# ---- lists ---------------------------------------------------------------------------------------------------


@query("SELECT id, coalesce(published_at, discovered_at) AS sort_key, source_title, status FROM es WHERE status = 'unread' ORDER BY sort_key DESC, id DESC LIMIT 50")
def newest_first(d: Domain) -> DataFrame:
    rows = filters.matching(joins.with_sources(d.entries, d.sources), filters.EntryFilter(status="unread"))
    return paging.newest_first(rows).select("id", "sort_key", "source_title", "status").limit(50)


@query("SELECT e.id, r.score FROM entries e JOIN rankings r ON r.entry_id = e.id AND r.profile_id = 1 ORDER BY r.score DESC, e.id DESC LIMIT 50")
def ranked_list(d: Domain) -> DataFrame:
    return paging.ranked(joins.with_rankings(d.entries, d.rankings, 1)).select("id", "score").limit(50)


@query("SELECT id, coalesce(published_at, discovered_at) AS sort_key FROM entries WHERE coalesce(published_at, discovered_at) < '2024-06-10T00:00:00+00:00' OR (coalesce(published_at, discovered_at) = '2024-06-10T00:00:00+00:00' AND id < 500) ORDER BY sort_key DESC, id DESC LIMIT 40")
def keyset_time(d: Domain) -> DataFrame:
    return paging.page_after(d.entries, filters.sort_key(), "2024-06-10T00:00:00+00:00", 500, 40).select("id", "sort_key")


@query("SELECT e.id, r.score AS sort_key FROM entries e JOIN rankings r ON r.entry_id = e.id AND r.profile_id = 2 WHERE r.score < 55.5 OR (r.score = 55.5 AND e.id < 500) ORDER BY sort_key DESC, id DESC LIMIT 40")
def keyset_score(d: Domain) -> DataFrame:
    return paging.page_after(joins.with_rankings(d.entries, d.rankings, 2), F.col("score"), 55.5, 500, 40).select("id", "sort_key")


@query("SELECT entry_id, label, updated_at FROM feedback WHERE profile_id = 1 ORDER BY updated_at DESC, entry_id DESC LIMIT 200")
def recent_feedback(d: Domain) -> DataFrame:
    return paging.recent_feedback(d.feedback, 1).select("entry_id", "label", "updated_at")


@query("SELECT id, position, row_number() OVER (PARTITION BY citing_entry_id ORDER BY position ASC NULLS LAST, id) AS place FROM refs")
def nulls_last_refs(d: Domain) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("citing_entry_id").orderBy(F.asc_nulls_last("position"), "id")
    return d.references.select("id", "position", F.row_number().over(w).alias("place"))


@query("SELECT entry_id, scheme, value, is_primary FROM identifiers ORDER BY is_primary DESC, scheme, value")
def identifier_order(d: Domain) -> DataFrame:
    return paging.identifier_order(d.identifiers)


@query("SELECT id, title, category, content_kind FROM src ORDER BY content_kind, lower(category), lower(title), url")
def manifest_order(d: Domain) -> DataFrame:
    return paging.manifest_order(d.sources).select("id", "title", "category", "content_kind")


# ---- joins ---------------------------------------------------------------------------------------------------


@query("SELECT id, source_title, category FROM es")
def entries_sources(d: Domain) -> DataFrame:
    return joins.with_sources(d.entries, d.sources).select("id", "source_title", "category")


@query("SELECT s.category, count(e.id) AS n FROM src s LEFT JOIN entries e ON e.source_id = s.id GROUP BY s.category")
def left_zero_count(d: Domain) -> DataFrame:
    return joins.category_counts(d.sources, d.entries)


@query("SELECT p.content_kind, r.bucket, count(*) AS n FROM rankings r JOIN profiles p ON p.id = r.profile_id JOIN entries e ON e.id = r.entry_id WHERE e.content_kind = p.content_kind GROUP BY ALL")
def three_way_kind(d: Domain) -> DataFrame:
    return joins.bucket_counts(d.rankings, d.profiles, d.entries)


@query("SELECT r.id, r.cited_entry_id, e.title AS target_title, e.status AS target_status FROM refs r LEFT JOIN entries e ON e.id = r.cited_entry_id")
def refs_targets(d: Domain) -> DataFrame:
    return joins.references_with_targets(d.references, d.entries).select("id", "cited_entry_id", "target_title", "target_status")


@query("SELECT r.id, e.title AS target_title, x.state AS export_state FROM refs r LEFT JOIN entries e ON e.id = r.cited_entry_id LEFT JOIN exports x ON x.entry_id = r.cited_entry_id")
def refs_two_left(d: Domain) -> DataFrame:
    return joins.references_with_targets(d.references, d.entries, d.exports).select("id", "target_title", "export_state")


@query("SELECT r.id, min(i.entry_id) AS target FROM refs r JOIN identifiers i ON i.scheme = r.scheme AND i.value = r.value WHERE r.cited_entry_id IS NULL AND r.value <> '' AND i.entry_id <> r.citing_entry_id GROUP BY r.id")
def reconcile_by_id(d: Domain) -> DataFrame:
    return joins.resolved_by_identifier(d.references, d.identifiers)


@query("SELECT r.id, min(e.id) AS target FROM refs r JOIN entries e ON e.url = r.url OR e.canonical_url = r.url WHERE r.cited_entry_id IS NULL AND r.url <> '' AND e.id <> r.citing_entry_id GROUP BY r.id")
def reconcile_by_url(d: Domain) -> DataFrame:
    return joins.resolved_by_url(d.references, d.entries)


@query("""SELECT r.id, coalesce(r.cited_entry_id, (SELECT min(i.entry_id) FROM identifiers i WHERE i.scheme = r.scheme AND i.value = r.value AND r.value <> '' AND i.entry_id <> r.citing_entry_id),
  (SELECT min(e.id) FROM entries e WHERE e.url = r.url AND r.url <> '' AND e.id <> r.citing_entry_id)) AS cited_entry_id FROM refs r""")
def reconcile_all(d: Domain) -> DataFrame:
    return joins.reconciled(d.references, d.identifiers, d.entries).select("id", "cited_entry_id")


def _incoming(d: Domain) -> DataFrame:
    s = d.sources
    return s.select(F.when(F.col("id") % 3 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")).alias("url"), F.when(F.col("id") % 4 == 1, F.upper("title")).otherwise(F.col("title")).alias("title"), "category", "content_kind")


_INCOMING = ", incoming AS (SELECT CASE WHEN id % 3 = 0 THEN url || '/new' ELSE url END AS url, CASE WHEN id % 4 = 1 THEN upper(title) ELSE title END AS title, category, content_kind FROM src), diff AS (SELECT i.*, CASE WHEN s.url IS NULL THEN 'created' WHEN s.title IS NOT DISTINCT FROM i.title AND s.category IS NOT DISTINCT FROM i.category THEN 'unchanged' ELSE 'updated' END AS action FROM incoming i LEFT JOIN src s ON s.url = i.url)\n"


@query(_INCOMING + "SELECT url, title, action FROM diff")
def import_diff(d: Domain) -> DataFrame:
    return joins.import_difference(_incoming(d), d.sources, "url", ["title", "category"]).select("url", "title", "action")


@query(_INCOMING + "SELECT CAST(count_if(action = 'created') AS BIGINT) AS created, CAST(count_if(action = 'updated') AS BIGINT) AS updated, CAST(count_if(action = 'unchanged') AS BIGINT) AS unchanged FROM diff")
def import_tally(d: Domain) -> DataFrame:
    return merge.tally(joins.import_difference(_incoming(d), d.sources, "url", ["title", "category"]))


@query("SELECT title, count(DISTINCT citing_entry_id) AS entries FROM refs GROUP BY title HAVING count(DISTINCT citing_entry_id) > 1")
def ambiguity(d: Domain) -> DataFrame:
    return joins.ambiguous(d.references.select("title", F.col("citing_entry_id").alias("entry_id")), "title")


def _cache(d: Domain) -> DataFrame:
    return d.entries.where("id % 3 = 0").select(F.sha2("title", 256).alias("content_hash"), F.lit("m1").alias("model"), F.lit(True).alias("vector")).distinct()


@query("SELECT e.id, sha256(e.title) AS content_hash, c.hit FROM entries e LEFT JOIN (SELECT DISTINCT sha256(title) AS h, true AS hit FROM entries WHERE id % 3 = 0) c ON c.h = sha256(e.title)")
def cache_probe(d: Domain) -> DataFrame:
    return joins.cache_probe(d.entries.select("id", F.col("title").alias("text")), _cache(d), "m1").select("id", "content_hash", F.col("vector").alias("hit"))


# ---- aggregates ----------------------------------------------------------------------------------------------

_STATUS_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS status" for s in STATUSES)
_KIND_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS content_kind" for k in KINDS)


@query(f"SELECT g.status, count(e.id) AS n FROM ({_STATUS_ROWS}) g LEFT JOIN entries e ON e.status = g.status GROUP BY g.status")
def stats_status(d: Domain) -> DataFrame:
    return counts.by_status(d.entries)


@query(f"SELECT k.content_kind, count(e.id) AS n FROM ({_KIND_ROWS}) k LEFT JOIN entries e ON e.content_kind = k.content_kind GROUP BY k.content_kind")
def stats_kind(d: Domain) -> DataFrame:
    return counts.by_kind(d.entries)


@query(f"SELECT k.content_kind, g.status, count(e.id) AS n FROM ({_KIND_ROWS}) k, ({_STATUS_ROWS}) g LEFT JOIN entries e ON e.status = g.status AND e.content_kind = k.content_kind GROUP BY ALL")
def stats_kind_status(d: Domain) -> DataFrame:
    return counts.by_kind_and_status(d.entries)


@query("SELECT content_kind, status, count(*) AS n FROM entries GROUP BY GROUPING SETS ((content_kind, status), (content_kind), (status), ())")
def stats_all_levels(d: Domain) -> DataFrame:
    return counts.all_levels(d.entries)


@query("""SELECT k.content_kind, k.total, coalesce(b.relevant, 0) AS relevant, coalesce(b.filtered, 0) AS filtered, greatest(0, k.total - coalesce(b.relevant, 0) - coalesce(b.filtered, 0)) AS pending
FROM (SELECT content_kind, count(*) AS total FROM entries GROUP BY content_kind) k LEFT JOIN (
  SELECT p.content_kind, CAST(count_if(bucket = 'relevant') AS BIGINT) AS relevant, CAST(count_if(bucket = 'filtered') AS BIGINT) AS filtered FROM rankings r JOIN profiles p ON p.id = r.profile_id JOIN entries e ON e.id = r.entry_id AND e.content_kind = p.content_kind GROUP BY p.content_kind) b USING (content_kind)""")
def pending_derived(d: Domain) -> DataFrame:
    return counts.pending(d.entries, joins.bucket_counts(d.rankings, d.profiles, d.entries))


@query("SELECT DISTINCT citing_entry_id FROM refs WHERE cited_entry_id = 33 AND citing_entry_id <> 33")
def distinct_citing(d: Domain) -> DataFrame:
    return counts.citing(d.references, 33)


_TF = f", tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS.format('content')}) AS term FROM entries) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)\n"


def _tf(d: Domain) -> DataFrame:
    return ranking.term_frequencies(d.entries.select("id", "content"), "id", F.col("content"))


@query(_TF + "SELECT id, term, tf FROM tf")
def term_frequency(d: Domain) -> DataFrame:
    return _tf(d)


@query(_TF + "SELECT term, df FROM df")
def document_frequency(d: Domain) -> DataFrame:
    return ranking.document_frequencies(_tf(d))


_W = _TF[:-1] + ", raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), (SELECT count(*) AS n FROM entries)), norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id)\n"


@query(_W + "SELECT id, round(norm, 6) AS norm FROM norm")
def l2_norm(d: Domain) -> DataFrame:
    raw = ranking.raw_weights(_tf(d), d.entries.count())
    return ranking.norms(raw, "id").select("id", F.round("norm", 6).alias("norm"))


@query(_W + "SELECT id, term, round(w / norm, 6) AS w FROM raw JOIN norm USING (id)")
def tfidf(d: Domain) -> DataFrame:
    return ranking.tfidf(_tf(d), "id", d.entries.count()).select("id", "term", F.round("w", 6).alias("w"))


@query(_W + "SELECT a.id, b.item, round(sum(a.w / n.norm * b.w), 6) AS dot FROM raw a JOIN norm n USING (id) JOIN (SELECT id AS item, term, w / norm AS w FROM raw JOIN norm USING (id) WHERE id % 500 = 0) b USING (term) GROUP BY a.id, b.item")
def sparse_dot(d: Domain) -> DataFrame:
    """Every document against a query set: the documents whose id is divisible by 500."""
    dots = ranking.sparse_dots(d.entries.select("id", "content"), "id", F.col("content"), d.entries.count(), F.col("id") % 500 == 0)
    return dots.select("id", "item", F.round("dot", 6).alias("dot"))


@query("SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id % 50 = 0")
def dense_cosine(d: Domain) -> DataFrame:
    """Every vector against the vectors of its label in a query set: those whose id is divisible by 50."""
    e = d.table("embeddings")
    small = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("other"), "label", F.col("embedding").alias("b"))
    return e.join(small, "label").select("vec_id", "other", F.round(ranking.dense_cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("SELECT profile_id, quantile_disc(score, 0.9) AS threshold FROM rankings GROUP BY profile_id")
def percentile_disc(d: Domain) -> DataFrame:
    return d.rankings.groupBy("profile_id").agg(ranking.percentile("score", 0.9).alias("threshold"))


@query("SELECT e.source_id, count_if(label = 'keep') / count(*) AS ratio FROM feedback f JOIN entries e ON e.id = f.entry_id GROUP BY e.source_id")
def source_ratio(d: Domain) -> DataFrame:
    return ranking.source_ratio(d.feedback, d.entries)


_CURVE = ", curve AS (SELECT DISTINCT score, count(*) OVER w AS selected, CAST(count_if(label = 'keep') OVER w AS BIGINT) AS true_positives, count_if(label = 'keep') OVER w / count(*) OVER w AS precision FROM rankings r JOIN feedback f ON f.entry_id = r.entry_id AND f.profile_id = r.profile_id WHERE r.profile_id = 1 WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))\n"


def _curve(d: Domain) -> DataFrame:
    rows = d.rankings.where("profile_id = 1").join(d.feedback, ["entry_id", "profile_id"])
    return ranking.precision_curve(rows.select("score", (F.col("label") == "keep").alias("keep")))


@query(_CURVE + "SELECT * FROM curve")
def precision_curve(d: Domain) -> DataFrame:
    return _curve(d)


@query(_CURVE + "SELECT min(score) AS threshold FROM curve WHERE true_positives >= 5 AND precision >= 0.75")
def min_safe_threshold(d: Domain) -> DataFrame:
    return ranking.learned_threshold(_curve(d), 0.75)


_RECENT = ", recent AS (SELECT * FROM feedback WHERE profile_id = 1 ORDER BY updated_at DESC, entry_id DESC LIMIT 200)\n"


@query(_RECENT + "SELECT f.label, string_agg(e.title, chr(10) ORDER BY f.updated_at DESC, f.entry_id DESC, e.title DESC) AS joined FROM recent f JOIN entries e ON e.id = f.entry_id GROUP BY f.label")
def text_concat(d: Domain) -> DataFrame:
    """The texts that a profile's feedback queries are made of: those of its latest 200 rows."""
    rows = paging.recent_feedback(d.feedback, 1).join(d.entries.select(F.col("id").alias("entry_id"), "title"), "entry_id")
    return counts.joined_text(rows, "label", "title", ["updated_at", "entry_id"])


@query(_RECENT + """, cold AS (SELECT quantile_disc(score, 0.9) AS t FROM rankings WHERE profile_id = 1),
labelled AS (SELECT r.score, f.label FROM rankings r JOIN recent f ON f.entry_id = r.entry_id WHERE r.profile_id = 1),
curve AS (SELECT DISTINCT score, count_if(label = 'keep') OVER w AS tp, count_if(label = 'keep') OVER w / count(*) OVER w AS precision FROM labelled WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
learned AS (SELECT min(score) AS t FROM curve WHERE tp >= 5 AND precision >= 0.6), gate AS (SELECT count_if(label = 'keep') AS k, count_if(label = 'discard') AS d FROM recent)
SELECT CASE WHEN k < 5 OR d < 15 THEN cold.t WHEN learned.t IS NULL THEN 40.0 ELSE greatest(37.0, least(43.0, learned.t)) END AS threshold,
  CASE WHEN k < 5 OR d < 15 THEN 'cold-start' WHEN learned.t IS NULL THEN 'adaptive-no-safe-threshold' ELSE 'adaptive-feedback' END AS reason FROM cold, learned, gate""")
def adaptive_threshold(d: Domain) -> DataFrame:
    """The threshold that a profile learns from its latest 200 rows of feedback, at most three points from the present one."""
    profile = ranking.Profile(1, "paper", ("x",), target_precision=0.6, threshold=40.0)
    rows = d.rankings.where("profile_id = 1").select(F.col("entry_id").alias("id"), "score", F.lit(False).alias("blocked"))
    threshold, reason = ranking.choose_threshold(rows, profile, d.feedback)
    return d.spark.createDataFrame([(float(threshold), reason)], "threshold double, reason string")


@query("SELECT category FROM src UNION SELECT category FROM es")
def categories_union(d: Domain) -> DataFrame:
    return counts.categories(d.sources, joins.with_sources(d.entries, d.sources))


@query("SELECT CAST(count_if(status = 'kept') AS BIGINT) AS created, CAST(count_if(status = 'discarded') AS BIGINT) AS updated, CAST(count_if(content_kind = 'news') AS BIGINT) AS failures FROM entries")
def run_totals(d: Domain) -> DataFrame:
    runs = d.entries.select((F.col("status") == "kept").cast("long").alias("created"), (F.col("status") == "discarded").cast("long").alias("updated"), F.when(F.col("content_kind") == "news", "x").otherwise("").alias("error"))
    return counts.run_totals(runs)


# ---- merges --------------------------------------------------------------------------------------------------


def _revised(d: Domain) -> DataFrame:
    """Half of the entries come again with other texts, some blank; others are new."""
    e = d.entries
    i = F.col("id")
    return e.where("id % 2 = 0").select(
        "source_id", F.when(i % 10 == 0, F.concat(F.lit("n"), i)).otherwise(F.col("guid")).alias("guid"), F.concat(F.lit("Again "), i).alias("title"), F.when(i % 4 == 0, "").otherwise("new text").alias("content"),
        F.lit("short").alias("summary"), F.when(i % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), i)).alias("canonical_key"),
    )


@query("""SELECT coalesce(e.source_id, r.source_id) AS source_id, coalesce(e.guid, r.guid) AS guid, CASE WHEN r.guid IS NOT NULL THEN r.title ELSE e.title END AS title,
  CASE WHEN r.guid IS NOT NULL AND (e.guid IS NULL OR r.content <> '') THEN r.content ELSE e.content END AS content, CASE WHEN r.guid IS NOT NULL THEN r.summary ELSE e.summary END AS summary, CASE WHEN r.guid IS NULL THEN e.canonical_key ELSE coalesce(r.canonical_key, e.canonical_key) END AS canonical_key, e.status
FROM entries e FULL JOIN (SELECT source_id, CASE WHEN id % 10 = 0 THEN 'n' || id ELSE guid END AS guid, 'Again ' || id AS title, CASE WHEN id % 4 = 0 THEN '' ELSE 'new text' END AS content, 'short' AS summary, CASE WHEN id % 6 = 0 THEN NULL ELSE 'k' || id END AS canonical_key FROM entries WHERE id % 2 = 0) r
ON r.source_id = e.source_id AND r.guid = e.guid""")
def upsert_entry(d: Domain) -> DataFrame:
    old = d.entries.select("source_id", "guid", "title", "content", "summary", "canonical_key", "status")
    return merge.upsert(old, _revised(d), ["source_id", "guid"], merge.ENTRY_RULES)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'Someone' ELSE author END AS author, title FROM entries")
def fill_only(d: Domain) -> DataFrame:
    found = d.entries.where("id % 3 = 0").select("id", F.lit("Someone").alias("author"), F.lit("other").alias("title"))
    return merge.fill_metadata(d.entries.select("id", "author", "title"), found, ["author", "title"])


@query(_INCOMING + "SELECT coalesce(s.url, i.url) AS url, coalesce(i.title, s.title) AS title, coalesce(i.category, s.category) AS category, s.enabled FROM src s FULL JOIN incoming i ON i.url = s.url")
def merge_source(d: Domain) -> DataFrame:
    return merge.upsert(d.sources.select("url", "title", "category", "enabled"), _incoming(d).select("url", "title", "category"), ["url"], {})


@query("SELECT user_id AS source_id, 'g' || (event_id % 50) AS guid FROM events UNION SELECT DISTINCT user_id, 'g' || (event_id % 70) FROM events")
def insert_ignore(d: Domain) -> DataFrame:
    rows = lambda m: d.table("events").select(F.col("user_id").alias("source_id"), F.concat(F.lit("g"), F.col("event_id") % m).alias("guid"))
    return merge.insert_ignore(rows(50).distinct(), rows(70), ["source_id", "guid"])


@query("SELECT entry_id, value FROM identifiers WHERE entry_id % 4 <> 0 UNION ALL SELECT entry_id, 'new' FROM identifiers WHERE entry_id % 4 = 0")
def replace_keywords(d: Domain) -> DataFrame:
    rows = d.identifiers.select("entry_id", "value")
    return merge.replace_for(rows, rows.where("entry_id % 4 = 0").select("entry_id", F.lit("new").alias("value")), "entry_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_feedback(d: Domain) -> DataFrame:
    return ingest.triage_state(d.table("events")).select("user_id", "event_type", "event_id", "value")


@query("SELECT item, entry FROM (SELECT 'x' || e.id AS item, e.id AS entry FROM entries e WHERE e.id % 3 = 0 UNION ALL SELECT 'y' || e.id, e.id FROM entries e WHERE e.id % 3 = 1)")
def upsert_match(d: Domain) -> DataFrame:
    e = d.entries
    by_key = e.where("id % 3 = 0").select(F.concat(F.lit("x"), "id").alias("item"), "source_id", "guid", F.lit("").alias("url"), F.lit("").alias("canonical_url"))
    by_url = e.where("id % 3 = 1").select(F.concat(F.lit("y"), "id").alias("item"), F.lit(-1).cast("long").alias("source_id"), "guid", "url", "canonical_url")
    return merge.matched_ids(by_key.unionByName(by_url), e)


@query("SELECT row_number() OVER (ORDER BY discovered_at, guid) + 1000 AS id, guid FROM entries WHERE status = 'kept'")
def assigned_ids(d: Domain) -> DataFrame:
    return merge.with_ids(d.entries.where("status = 'kept'").select("discovered_at", "guid"), 1001, ["discovered_at", "guid"]).select("id", "guid")


_CANON = """, p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages
), c AS (SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(k) = 0 THEN '' ELSE '?' || array_to_string(k, '&') END AS url FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'gclid'))) AS k FROM p))
"""


@query(_CANON + "SELECT page_id, url AS canonical FROM c")
def canonical_url(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@query(_CANON + "SELECT url AS canonical, min(page_id) AS page_id, count(*) AS n FROM c GROUP BY url")
def dedup_pages(d: Domain) -> DataFrame:
    return d.table("pages").groupBy(url.canonical_url(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


# ---- scalar functions ----------------------------------------------------------------------------------------


@query(f"SELECT id, trim(regexp_replace(content, '{_SP}+', ' ', 'g')) AS line FROM entries")
def collapse_ws(d: Domain) -> DataFrame:
    return d.entries.select("id", tx.collapse_strip(F.col("content")).alias("line"))


@query("SELECT id, len(CASE WHEN content = '' THEN [] WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END) AS n FROM entries")
def line_count(d: Domain) -> DataFrame:
    return d.entries.select("id", F.size(tx.split_lines(F.col("content"))).cast("long").alias("n"))


_URL_PARTS = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment"


@query(f"SELECT page_id, {_URL_PARTS} FROM pages")
def split_url(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", url.split_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query("SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1)) AS host FROM pages")
def hostname(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", url.hostname(url.split_url(F.col("url"))["netloc"]).alias("host"))


@query("SELECT page_id, split_part(x, '=', 1) AS key, split_part(x, '=', 2) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS x FROM pages) WHERE x <> ''")
def parse_query(d: Domain) -> DataFrame:
    pairs = url.parse_query(url.split_url(F.col("url"))["query"])
    return d.table("pages").select("page_id", F.explode(pairs).alias("x")).select("page_id", "x.key", "x.value")


@query("SELECT id, replace(url_encode(title), '%20', '+') AS coded, title AS back FROM entries")
def quote_plus(d: Domain) -> DataFrame:
    coded = url.quote_plus(F.col("title"))
    return d.entries.select("id", coded.alias("coded"), url.unquote(F.replace(coded, F.lit("+"), F.lit("%20"))).alias("back"))


@query(f"SELECT id, {_TOKENS.format('title')} AS terms, list_aggregate(list_sort(list_distinct({_TOKENS.format('title')})), 'string_agg', ' ') AS term_set FROM entries")
def tokens(d: Domain) -> DataFrame:
    t = tx.tokens(F.col("title"))
    return d.entries.select("id", t.alias("terms"), F.when(F.size(t) > 0, F.array_join(F.array_sort(tx.unique_tokens(F.col("title"))), " ")).alias("term_set"))


@query("SELECT source_id, list_sort(list(DISTINCT lower(regexp_extract(title, '^[A-Za-z]+')))) AS phrases FROM entries WHERE regexp_extract(title, '^[A-Za-z]+') <> '' GROUP BY source_id")
def clean_phrases(d: Domain) -> DataFrame:
    word = F.regexp_extract("title", "^[A-Za-z]+", 0)
    rows = d.entries.where(word != "").groupBy("source_id").agg(F.array_sort(F.collect_list(F.concat(F.lit(" "), word, F.lit(" ")))).alias("p"))
    return rows.select("source_id", F.array_sort(F.transform(tx.clean_phrases(F.col("p")), F.lower)).alias("phrases"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN '10.1000/' || id END AS doi FROM entries")
def doi(d: Domain) -> DataFrame:
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" https://doi.org/10.1000/"), "id", F.lit("."))).when(F.col("id") % 2 == 0, F.concat(F.lit("DOI: 10.1000%2F"), "id")).otherwise(F.concat(F.lit("see 10.1000/"), "id"))
    return d.entries.select("id", ids.doi(raw).alias("doi"))


_FOUR = "lpad(CAST(id % 10000 AS VARCHAR), 4, '0')"


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN {_FOUR} || '.12345' WHEN id % 3 = 1 THEN 'hep-th/' || lpad(CAST(id AS VARCHAR), 7, '0') END AS arxiv FROM entries")
def arxiv(d: Domain) -> DataFrame:
    four, i = F.lpad((F.col("id") % 10000).cast("string"), 4, "0"), F.col("id") % 3
    raw = F.when(i == 0, F.concat(F.lit("https://arxiv.org/pdf/"), four, F.lit(".12345v2.pdf"))).when(i == 1, F.concat(F.lit("arXiv: HEP-TH/"), F.lpad(F.col("id").cast("string"), 7, "0"))).otherwise(F.concat(four, F.lit(".1")))
    return d.entries.select("id", ids.arxiv(raw).alias("arxiv"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'doi' WHEN id % 4 = 1 THEN 's2' WHEN id % 4 = 2 THEN 'url' END AS scheme, CASE WHEN id % 4 = 0 THEN '10.1000/' || id WHEN id % 4 = 1 THEN lpad(CAST(id AS VARCHAR), 40, '0') WHEN id % 4 = 2 THEN 'https://example.org/p/' || id END AS value FROM entries")
def locator(d: Domain) -> DataFrame:
    i = F.col("id") % 4
    raw = F.when(i == 0, F.concat(F.lit("https://doi.org/10.1000/"), "id")).when(i == 1, F.concat(F.lit("https://www.semanticscholar.org/paper/x/"), F.lpad(F.col("id").cast("string"), 40, "0"))).when(i == 2, F.concat(F.lit("https://example.org/p/"), "id")).otherwise(F.concat(F.lit("http://127.0.0.1/"), "id"))
    return d.entries.select("id", ids.locator(raw).alias("l")).select("id", "l.scheme", "l.value")


# An address inside and beside each range that is not public, and whether a page there may be fetched.
_ADDRESSES = {
    "0.1.2.3": 0, "1.0.0.1": 1, "10.255.0.1": 0, "11.0.0.1": 1, "100.63.9.9": 1, "100.64.0.1": 0, "100.127.255.254": 0, "100.128.0.1": 1, "127.0.0.1": 0, "128.0.0.1": 1, "169.254.1.1": 0,
    "169.253.1.1": 1, "172.15.0.1": 1, "172.16.0.1": 0, "172.31.9.9": 0, "172.32.0.1": 1, "192.0.0.9": 0, "192.0.1.9": 1, "192.0.2.1": 0, "192.168.1.1": 0, "192.169.1.1": 1, "198.17.0.5": 1,
    "198.18.0.5": 0, "198.19.0.5": 0, "198.20.0.5": 1, "198.51.100.7": 0, "198.51.101.7": 1, "203.0.113.9": 0, "203.0.114.9": 1, "223.255.255.1": 1, "224.0.0.1": 0, "240.0.0.1": 0, "255.255.255.255": 0,
    "[::1]": 0, "[::]": 0, "[fe80::1]": 0, "[fd12:3456::1]": 0, "[ff02::1]": 0, "[2001:db8::1]": 0, "[2606:4700::1111]": 1, "[2001:4860:4860::8888]": 1, "[::ffff:10.0.0.1]": 0, "[::ffff:8.8.8.8]": 1,
    "localhost": 0, "printer.local": 0, "example.org": 1, "10.example.org": 1,
}


@query(f"SELECT id, ([{', '.join(map(repr, _ADDRESSES))}])[CAST(id % {len(_ADDRESSES)} + 1 AS INTEGER)] AS address, ([{', '.join(map(str, _ADDRESSES.values()))}])[CAST(id % {len(_ADDRESSES)} + 1 AS INTEGER)] = 1 AS open FROM entries")
def public_address(d: Domain) -> DataFrame:
    address = F.element_at(F.array(*map(F.lit, _ADDRESSES)), (F.col("id") % len(_ADDRESSES) + 1).cast("int"))
    rows = d.entries.select("id", address.alias("address"))
    return rows.select("id", "address", ids.locator(F.concat(F.lit("https://"), "address", F.lit("/p")))["scheme"].eqNullSafe("url").alias("open"))


@query("SELECT id, 'generated:' || sha256(concat_ws(chr(31), title, url, coalesce(published_at, ''))) AS guid FROM entries")
def guid_sha(d: Domain) -> DataFrame:
    return d.entries.select("id", ids.generated_guid(F.col("title"), F.col("url"), F.col("published_at")).alias("guid"))


def _trim(text: str, limit: int) -> str:
    head = f"substr({text}, 1, {limit - 1})"
    at = f"regexp_replace(CASE WHEN contains({head}, ' ') THEN regexp_replace({head}, '(?s) [^ ]*$', '') ELSE {head} END, '[ ,;:-]+$', '')"
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE regexp_replace(CASE WHEN {at} = '' THEN {head} ELSE {at} END, '{_SP}+$', '') || '…' END"


@query(f"SELECT id, {_trim('title', 40)} AS short FROM entries")
def trim_to_word(d: Domain) -> DataFrame:
    return d.entries.select("id", tx.trim_to_word(F.col("title"), 40).alias("short"))


_LINE = f"trim(regexp_replace(content, '{_SP}+', ' ', 'g'))"
_SENTENCES = f"string_split(regexp_replace({_LINE}, '([.!?]) ([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30))"


@query(f"SELECT id, len(s) AS n, s[1] AS first FROM (SELECT id, {_SENTENCES} AS s FROM entries)")
def sentences(d: Domain) -> DataFrame:
    s = tx.sentences(tx.collapse_strip(F.col("content")))
    return d.entries.select("id", F.size(s).cast("long").alias("n"), F.element_at(s, 1).alias("first"))


def _summary_sql() -> str:
    text = f"CASE WHEN {_LINE} = '' THEN trim(regexp_replace(title, '{_SP}+', ' ', 'g')) ELSE {_LINE} END"
    one, two, three = "s[1]", "s[1] || ' ' || s[2]", "s[1] || ' ' || s[2] || ' ' || s[3]"
    picked = f"CASE WHEN len(s) = 1 OR length({one}) >= 600 OR length({two}) > 600 THEN {one} WHEN len(s) = 2 OR length({two}) >= 600 OR length({three}) > 600 THEN {two} ELSE {three} END"
    return f"SELECT id, CASE WHEN t = '' THEN 'No summary is available.' ELSE {_trim('p', 600)} END AS summary FROM (SELECT id, t, {picked} AS p FROM (SELECT id, {text} AS t, {_SENTENCES} AS s FROM entries))"


@query(_summary_sql())
def summary(d: Domain) -> DataFrame:
    return d.entries.select("id", tx.summary(F.col("title"), F.col("content")).alias("summary"))


@query("SELECT id, md5(trim(concat_ws(chr(10), title, title, content, source_title || ' ' || category), chr(10) || ' ')) AS digest FROM es")
def entry_text(d: Domain) -> DataFrame:
    e = joins.with_sources(d.entries, d.sources)
    return e.select("id", F.md5(tx.entry_text(F.col("title"), F.col("content"), F.col("source_title"), F.col("category"))).alias("digest"))


def _lexical_sql() -> str:
    one = lambda words: f"least(1.0, ({' + '.join(f'''CASE WHEN list_contains(tt, '{w}') THEN 2 WHEN list_contains(ct, '{w}') THEN 1 ELSE 0 END''' for w in words)}) / {2.0 * len(words)})"
    ratios = [one([w for w in i.split() if w not in tx.STOP_WORDS]) for i in INTERESTS]
    return f"SELECT id, round(greatest({', '.join(ratios)}), 6) AS best FROM (SELECT id, {_TOKENS.format('title')} AS tt, {_TOKENS.format('content')} AS ct FROM entries)"


@query(_lexical_sql())
def lexical(d: Domain) -> DataFrame:
    rows = d.entries.select("id", tx.unique_tokens(F.col("title")).alias("t"), tx.unique_tokens(F.col("content")).alias("c"))
    return rows.select("id", F.round(tx.lexical(F.col("t"), F.col("c"), INTERESTS)["best"], 6).alias("best"))


_KSTOPS = ", ".join(f"'{w}'" for w in keywords.STOP_WORDS)
_WORDS = "list_transform(regexp_extract_all({0}, '(?i)[a-z](?:[a-z0-9+.-]*[a-z0-9+])?'), lambda w: lower(w))"


@query(f"""SELECT id, phrase, round(sum(w), 3) AS score FROM (
  SELECT id, array_to_string(ws[i:i + n - 1], ' ') AS phrase, weight * (1 + 0.55 * (n - 1)) AS w FROM (
    SELECT id, ws, weight, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (
      SELECT id, {_WORDS.format('title')} AS ws, 4.0 AS weight FROM entries UNION ALL SELECT id, {_WORDS.format('content')}, 1.0 FROM entries), (SELECT unnest([1, 2, 3]) AS n))
  WHERE len(list_intersect(ws[i:i + n - 1], [{_KSTOPS}])) = 0) WHERE length(phrase) >= 4 GROUP BY id, phrase""")
def keyword_scores(d: Domain) -> DataFrame:
    return keywords.totals(d.entries, "id", "title", "content")


@query()
def keyword_top(d: Domain) -> DataFrame:
    return keywords.extract(d.entries, "id", "title", "content")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') AS published_at FROM events")
def parse_date(d: Domain) -> DataFrame:
    e = d.table("events")
    mail = F.concat(F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek("ts")), F.lit(", "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", dates.published_at(F.when(F.col("event_id") % 2 == 0, mail).otherwise(iso)).alias("published_at"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 7 / 3 * 10000) / 10000 + 0.0 AS r FROM lineitem")
def round4(d: Domain) -> DataFrame:
    return d.table("lineitem").select("l_orderkey", "l_linenumber", tx.round_to(F.col("l_extendedprice") * 7 / 3, 4).alias("r"))


# ---- ranking -------------------------------------------------------------------------------------------------

PROFILE = ranking.Profile(1, "paper", tuple(INTERESTS), exclusions=("ther thand",), include=("ing the",), never=("zqxzqx",))


def _scoring(d: Domain) -> DataFrame:
    return joins.with_sources(d.entries, d.sources)


@query()
def score_tfidf(d: Domain) -> DataFrame:
    return ranking.rescore(_scoring(d), PROFILE, d.feedback).rankings.select("entry_id", "profile_id", F.round("score", 4).alias("score"), "bucket")


@query()
def cold_start(d: Domain) -> DataFrame:
    run = ranking.rescore(_scoring(d), PROFILE, d.feedback.where("false"))
    return run.rankings.agg(F.lit(run.threshold).alias("threshold"), F.lit(run.reason).alias("reason"), F.count_if(F.col("bucket") == "relevant").alias("relevant"), F.count(F.lit(1)).alias("n"))


@query("SELECT entry_id, bucket AS was, CASE WHEN score < t THEN 'filtered' ELSE 'relevant' END AS bucket FROM rankings r JOIN (SELECT profile_id, quantile_disc(score, 0.7) AS t FROM rankings GROUP BY profile_id) USING (profile_id)")
def bucketed(d: Domain) -> DataFrame:
    r = d.rankings
    t = r.groupBy("profile_id").agg(ranking.percentile("score", 0.7).alias("t"))
    rows = r.join(t, "profile_id").select("entry_id", F.col("bucket").alias("was"), "score", "t", F.lit(False).alias("blocked"))
    return ranking.bucketed(rows, F.col("t")).select("entry_id", "was", "bucket")


# ---- markup, notes and streams -------------------------------------------------------------------------------


@query()
def html_text(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", markup.html_text("html").alias("text"))


@query()
def html_markdown(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", markup.html_markdown("html", "url").alias("markdown"))


def _landed(d: Domain) -> DataFrame:
    """Each entry as an Atom document of its own."""
    item = F.concat(F.lit("<entry><id>"), "guid", F.lit("</id><title>"), _escaped("title"), F.lit("</title><link href='"), "url", F.lit("?utm_source=x'/><updated>"), F.coalesce("published_at", "discovered_at"), F.lit("</updated><summary>"), _escaped(F.substring("title", 1, 30)), F.lit("</summary></entry>"))
    return d.entries.select(F.col("id").alias("source_id"), F.encode(F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), item, F.lit("</feed>")), "UTF-8").alias("document"))


def _escaped(c) -> F.Column:
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("SELECT id AS source_id, guid, url, coalesce(published_at, discovered_at) AS published_at FROM entries")
def feed_parse(d: Domain) -> DataFrame:
    return feeds.read_items(_landed(d)).select("source_id", "guid", "url", "published_at")


@query("SELECT page_id, 'https://example.org/feed/' || page_id AS feed FROM pages")
def feed_discover(d: Domain) -> DataFrame:
    document = F.concat(F.lit("<html><head><link rel='Alternate' type='application/rss+xml; charset=utf-8' href='/feed/"), "page_id", F.lit("?utm_medium=a#x'></head>"), "html")
    return d.table("pages").select("page_id", feeds.discovered_feed(document, F.lit("https://example.org/a/b")).alias("feed"))


@query("SELECT page_id, 'Paper ' || page_id AS title, '10.1000/' || page_id AS doi, '2020-01-01T00:00:00+00:00' AS published_at FROM pages")
def citation_meta(d: Domain) -> DataFrame:
    head = F.concat(F.lit("<meta name='citation_title' content='Paper "), "page_id", F.lit("'><meta name='citation_doi' content='doi:10.1000/"), "page_id", F.lit("'><meta name='citation_date' content='2020'>"), "html")
    pages = d.table("pages").select("page_id", head.alias("document"), F.lit("https://example.org/x").alias("page"))
    return feeds.citation_metadata(pages, "page_id", "document", "page").select("page_id", "title", "doi", "published_at")


@query()
def note_render(d: Domain) -> DataFrame:
    kept = joins.with_sources(d.entries.where("status = 'kept'"), d.sources)
    refs = joins.references_with_targets(d.references, d.entries, d.exports)
    target = F.when((F.col("target_status") == "kept") & (F.col("export_state") == "synced"), F.concat(F.lit("Papers/"), F.col("cited_entry_id").cast("string")))
    each = refs.select(F.col("citing_entry_id").alias("id"), F.struct(F.coalesce("position", F.lit(1 << 30)).alias("o"), F.col("id").alias("i"), F.coalesce("target_title", "title").alias("title"), target.alias("note"), notes.external_url(F.col("scheme"), F.col("value"), F.col("url")).alias("url")).alias("r"))
    grouped = each.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("references"))
    rows = kept.join(grouped, "id", "left").withColumn("references", F.coalesce("references", F.array().cast(grouped.schema["references"].dataType))).withColumn("summary", tx.summary(F.col("title"), F.col("content"))).withColumn("keywords", F.array(F.col("category")))
    return notes.rendered(rows).select("id", "path", "text")


@query("SELECT id FROM entries e LEFT JOIN exports x ON x.entry_id = e.id WHERE status = 'kept' AND (x.state IS NULL OR x.state <> 'synced')")
def notes_to_sync(d: Domain) -> DataFrame:
    return notes.needs_sync(d.entries, d.exports, F.concat(F.lit("Papers/"), F.col("id").cast("string"), F.lit(".md"))).select("id")


def _stream_items(d: Domain) -> DataFrame:
    e = d.entries
    return e.select("source_id", "guid", "url", "canonical_url", "title", "author", "published_at", "content", "content_kind", F.col("discovered_at").alias("arrived"))


@query("SELECT row_number() OVER (ORDER BY source_id, guid) AS id, source_id, guid, title, status FROM (SELECT source_id, guid, title, 'unread' AS status FROM entries)")
def ingest_batches(d: Domain) -> DataFrame:
    """Two batches of the same items: the second changes nothing but what it repeats."""
    from inkwell.schema import ENTRIES

    items = _stream_items(d)
    empty = d.spark.createDataFrame([], ENTRIES)
    once = stored(ingest.merge_batch(empty, items, "2025-03-01T00:00:00+00:00"), "entries")  # a table, as between two batches of a stream
    twice = ingest.merge_batch(once, items.where("source_id % 2 = 0"), "2025-03-02T00:00:00+00:00")
    return twice.select("id", "source_id", "guid", "title", "status")


@query(_WINDOW + "SELECT source_id, guid FROM items, now WHERE kind = 'news' AND source_id % 4 = 1 AND ts < t - INTERVAL 30 DAY")
def skip_state(d: Domain) -> DataFrame:
    items = _items(d)
    now = items.agg(F.max("published") + F.expr("INTERVAL 15 DAYS")).first()[0]
    first = items.where("source_id % 4 = 1").select("source_id").distinct()
    empty = items.where("false").select("source_id", "guid")
    return ingest.skip_state(items, empty, first, F.lit(now))[1]


# ---- state ---------------------------------------------------------------------------------------------------

_NOW = "2025-03-01T00:00:00+00:00"


@query(f"""SELECT id, CASE WHEN status = 'kept' THEN 'On ' || title ELSE '' END AS summary, CASE WHEN status = 'kept' THEN 'own' END AS summary_provider,
CASE WHEN status = 'kept' THEN 'm' END AS summary_model, CASE WHEN status = 'kept' THEN '{_NOW}' END AS summary_generated_at FROM entries""")
def set_summary(d: Domain) -> DataFrame:
    """Kept entries get a summary with its provenance; others stay."""
    found = d.entries.where("status = 'kept'").select("id", F.concat(F.lit("On "), "title").alias("text"), F.lit("own").alias("provider"), F.lit("m").alias("model"))
    return state.set_summaries(d.entries, found, _NOW).select("id", "summary", "summary_provider", "summary_model", "summary_generated_at")


@query(f"""SELECT id, CASE status WHEN 'kept' THEN 'enriched' WHEN 'discarded' THEN 'failed' ELSE enrichment_state END AS enrichment_state,
CASE WHEN status = 'kept' THEN '{_NOW}' END AS enriched_at, CASE WHEN status = 'discarded' THEN 'timeout' END AS enrichment_error,
CASE WHEN status = 'kept' THEN coalesce(canonical_key, 'k:' || id) ELSE canonical_key END AS canonical_key FROM entries""")
def set_enrichment(d: Domain) -> DataFrame:
    """Kept entries are enriched (those without a key get one), discarded ones fail, unread ones have no attempt."""
    e = d.entries.where("status <> 'unread'")
    kept = F.col("status") == "kept"
    key = F.when(kept & F.col("canonical_key").isNull(), F.concat(F.lit("k:"), "id"))
    outcomes = e.select("id", F.when(kept, "enriched").otherwise("failed").alias("state"), F.lit("own").alias("provider"), F.when(~kept, "timeout").alias("error"), F.lit(None).cast("string").alias("canonical_url"), key.alias("canonical_key"))
    return state.set_enrichment(d.entries, outcomes, _NOW).select("id", "enrichment_state", "enriched_at", "enrichment_error", "canonical_key")


_PLAIN_TITLE = f"trim(regexp_replace(title, '{_SP}+', ' ', 'g'))"
_ASKED = f"""CASE WHEN {_LINE} = '' AND {_PLAIN_TITLE} = '' THEN 'empty content' WHEN status = 'unread' THEN 'no answer' WHEN status = 'discarded' THEN 'timeout' WHEN {_PLAIN_TITLE} = '' THEN 'empty answer' END"""


@query(f"""SELECT e.id, CASE WHEN reason IS NULL THEN answer ELSE s.summary END AS text, CASE WHEN reason IS NULL THEN 'own' ELSE 'fallback' END AS provider, CASE WHEN reason IS NULL THEN 'm' ELSE '' END AS model, reason
FROM (SELECT id, {_PLAIN_TITLE} AS answer, {_ASKED} AS reason FROM entries) e JOIN ({_summary_sql()}) s ON s.id = e.id""")
def summarised(d: Domain) -> DataFrame:
    """A model that answers kept entries with their title, fails on discarded ones and is not asked for unread ones."""
    e = d.entries.where("status <> 'unread'")
    answers = e.select("id", F.when(F.col("status") == "kept", F.col("title")).alias("generated"), F.when(F.col("status") == "discarded", "timeout").alias("error"))
    return state.summarised(d.entries, answers, "own", "m")


@query(f"""SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value, CASE WHEN n.key IS NULL THEN '2025' ELSE '{_NOW}' END AS updated_at
FROM (SELECT 'source.' || id AS key, '"' || category || '"' AS value FROM src) o FULL JOIN (SELECT 'source.' || source_id AS key, CAST(count(*) AS VARCHAR) AS value FROM entries WHERE status = 'kept' GROUP BY source_id) n ON n.key = o.key""")
def put_settings(d: Domain) -> DataFrame:
    """A setting for each source; those of sources with kept entries are set anew."""
    old = d.sources.select(F.concat(F.lit("source."), "id").alias("key"), F.concat(F.lit('"'), "category", F.lit('"')).alias("value"), F.lit("2025").alias("updated_at"))
    new = d.entries.where("status = 'kept'").groupBy("source_id").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.concat(F.lit(" source."), "source_id").alias("key"), "value")
    return state.put_settings(old, new, _NOW)


@query(f"""SELECT coalesce(n.h, o.h) AS content_hash, coalesce(n.model, o.model) AS model, coalesce(n.d, o.d) AS dimensions, CASE WHEN n.h IS NULL THEN '2025' ELSE '{_NOW}' END AS created_at
FROM (SELECT md5(CAST(vec_id AS VARCHAR)) AS h, 'a' AS model, 1 AS d FROM embeddings) o FULL JOIN (SELECT md5(CAST(vec_id AS VARCHAR)) AS h, CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS model, len(embedding) AS d FROM embeddings) n ON n.h = o.h AND n.model = o.model""")
def put_vectors(d: Domain) -> DataFrame:
    """Every vector is cached for one model; those of even labels again, those of odd ones for another model."""
    from inkwell.functions import vectors

    e = d.table("embeddings").withColumn("content_hash", F.md5(F.col("vec_id").cast("string")))
    old = e.select("content_hash", F.lit("a").alias("model"), F.lit(1).cast("long").alias("dimensions"), vectors.pack(F.slice("embedding", 1, 1)).alias("vector"), F.lit("2025").alias("created_at"))
    new = e.select("content_hash", F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("model"), F.size("embedding").cast("long").alias("dimensions"), vectors.pack(F.col("embedding")).alias("vector"))
    return state.put_vectors(old, new, _NOW).select("content_hash", "model", "dimensions", "created_at")


@query(f"SELECT entry_id AS id, CASE state WHEN 'failed' THEN '2025-02' ELSE CASE WHEN e.content_kind = 'paper' THEN '{_NOW}' END END AS restored_at FROM exports x JOIN entries e ON e.id = x.entry_id")
def mark_restored(d: Domain) -> DataFrame:
    """Archived notes of papers are restored; those with an earlier time keep it."""
    archives = d.exports.select(F.col("entry_id").alias("id"), "entry_id", F.when(F.col("state") == "failed", "2025-02").alias("restored_at"))
    return state.mark_restored(archives, d.entries.where("content_kind = 'paper'").select("id"), _NOW).select("id", "restored_at")


@query("""SELECT id, '{"category":' || to_json(category) || ',"kind":' || to_json(content_kind) || ',"title":' || replace(replace(replace(to_json(title), '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') || '}' AS document FROM es""")
def sorted_json(d: Domain) -> DataFrame:
    e = joins.with_sources(d.entries, d.sources)
    return e.select("id", state.sorted_json(F.create_map(F.lit("title"), "title", F.lit("kind"), "content_kind", F.lit("category"), "category")).alias("document"))
