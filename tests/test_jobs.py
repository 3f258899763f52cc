import threading

import pytest
from pyspark.sql import functions as F

from inkwell.plans import jobs
from inkwell.schema import ENTRIES, IDENTIFIERS, KEYWORDS, SKIPS, SOURCES, migrated
from inkwell.sources.notes import Conflict

FEED = "<rss><channel>{}</channel></rss>"


def item(n, day):
    return f"<item><guid>{n}</guid><link>https://e.org/{n}</link><title>T{n}</title><pubDate>{day} 2025 00:00:00 GMT</pubDate></item>"


def fetcher():
    """A function of its own, so that workers need not import this file."""
    whole = FEED.format(item("new", "20 Jan") + item("old", "1 Jan")).encode()
    response = jobs.Response

    def fetch(url, etag, modified):
        if "bad" in url:
            raise OSError("no route")
        if etag:
            return response()
        return response(b"<rss>") if "broken" in url else response(whole, etag="e1")

    return fetch


def test_refresh_isolates_failures_and_remembers_skips(spark, tmp_path):
    def store(df, name):
        path = f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    sources = migrated(spark.createDataFrame([(1, "https://a", "news", True), (2, "https://bad", "news", True), (3, "https://broken", "news", True), (4, "https://off", "news", False)], "id long, url string, content_kind string, enabled boolean"), SOURCES)
    entries, skips = spark.createDataFrame([], ENTRIES), spark.createDataFrame([], SKIPS)
    now = "2025-02-10T00:00:00+00:00"
    results = jobs.fetched(sources, fetcher())
    entries, skips, sources = jobs.refresh(sources, entries, skips, results, now, store)
    assert [r.guid for r in entries.collect()] == ["new"] and [tuple(r) for r in skips.collect()] == [(1, "old")]
    state = {r.id: r for r in sources.collect()}
    assert state[1].refresh_error == "" and state[1].etag == "e1" and "no route" in state[2].refresh_error and state[3].refresh_error and state[4].refreshed_at is None
    again = jobs.fetched(sources, fetcher())
    assert again.where("source_id = 1 and document is null and error = ''").count() == 1
    forced = spark.createDataFrame([(1, FEED.format(item("old", "1 Jan") + item("third", "2 Jan")).encode(), None, None, "")], again.schema)
    entries, skips, _ = jobs.refresh(sources, entries, skips, forced, now, store)
    assert sorted(r.guid for r in entries.collect()) == ["new", "third"]


def test_seed_and_demo(spark):
    known = jobs.seed(spark, spark.createDataFrame([], "url string"))
    assert known.count() == 48 and jobs.seed(spark, known).count() == 0
    assert jobs.demo(spark).count() == 2 and '"id": 1' in jobs.printed(jobs.demo(spark).orderBy("id"))
    assert jobs.as_json(jobs.demo(spark).select("id", F.lit(None).cast("string").alias("n"))).orderBy("json").first().json == '{"id":1,"n":null}'


def test_backfill_is_idempotent(spark):
    entries = migrated(spark.createDataFrame([(1, "https://arxiv.org/abs/2101.00001v2", "Sparse tensor cores", "paper"), (2, "https://doi.org/10.1000/X", "Other", "paper"), (3, "https://e.org", "N", "news")], "id long, url string, title string, content_kind string"), ENTRIES).withColumn("canonical_url", F.col("url")).withColumn("content", F.lit("Sparse tensor cores."))
    none = lambda s: spark.createDataFrame([], s)
    refs = spark.createDataFrame([(1, 2, None, "arxiv", "2101.00001", "")], "id long, citing_entry_id long, cited_entry_id long, scheme string, value string, url string")
    one = jobs.backfill(entries, none(IDENTIFIERS), refs, none(KEYWORDS))
    assert {(r.entry_id, r.scheme, r.value) for r in one["identifiers"].collect()} == {(1, "arxiv", "2101.00001"), (2, "doi", "10.1000/x")}
    assert {r.id: r.canonical_key for r in one["entries"].collect()} == {1: "arxiv:2101.00001", 2: "doi:10.1000/x", 3: None}
    assert one["references"].first().cited_entry_id == 1 and one["keywords"].where("entry_id = 1").count() > 0
    two = jobs.backfill(one["entries"], one["identifiers"], one["references"], one["keywords"])
    for name in one:
        assert sorted(map(str, one[name].collect())) == sorted(map(str, two[name].collect()))


def test_import_finds_entries_or_refuses(spark):
    idents = spark.createDataFrame([(1, "doi", "a"), (2, "arxiv", "b")], "entry_id long, scheme string, value string")
    works = spark.createDataFrame([(10, "a", None, None), (11, None, "zz", None)], "work_id long, doi string, arxiv string, s2 string")
    assert {r.work_id: r.entry_id for r in jobs.works_to_entries(works, idents).collect()} == {10: 1, 11: None}
    with pytest.raises(ValueError, match="several"):
        jobs.works_to_entries(spark.createDataFrame([(10, "a", "b", None)], works.schema), idents)
    cited = spark.createDataFrame([(5, [("doi", "a", "A", ""), ("doi", "a", "again", ""), ("url", "u", "U", "https://e.org/2")])], "entry_id long, refs array<struct<scheme:string,value:string,title:string,url:string>>")
    entries = spark.createDataFrame([(2, "https://e.org/2", "")], "id long, url string, canonical_url string")
    assert {(r.reference_key, r.cited_entry_id) for r in jobs.new_references(cited, entries, idents).collect()} == {("doi:a", 1), ("url:u", 2)}


def test_triage(spark):
    entries = spark.createDataFrame([(1, "unread", "paper", ""), (2, "kept", "news", "")], "id long, status string, content_kind string, updated_at string")
    feedback = spark.createDataFrame([(2, 2, "keep", "x")], "entry_id long, profile_id long, label string, updated_at string")
    e, f = jobs.changed_status(entries, feedback, spark.createDataFrame([(1, "kept"), (2, "read")], "id long, status string"), "now")
    assert {r.id: r.status for r in e.collect()} == {1: "kept", 2: "read"} and [(r.entry_id, r.label) for r in f.collect()] == [(1, "keep")]
    with pytest.raises(ValueError):
        jobs.changed_status(entries, feedback, spark.createDataFrame([(1, "x")], "id long, status string"), "now")
    r = entries.select(jobs.reasons(F.array(F.lit("a"), F.lit("a")), {"source": F.lit(1.0), "none": F.lit(0.0)}).alias("r")).first().r
    assert r == ["interest: a", "source"]
    assert jobs.page_filter(entries, " KEPT", ["status"]).count() == 1 and jobs.page_filter(entries, "", ["status"]).count() == 2


def test_coordinator_joins_requests():
    runs, gate, started = [], threading.Event(), threading.Event()

    def job(kind):
        runs.append(kind)
        started.set()
        gate.wait(5)
        if len(runs) == 2:
            raise ValueError("x")

    c = jobs.Coordinator(job)
    t = threading.Thread(target=c.request, args=("paper",))
    t.start()
    started.wait(5)
    assert [c.request("paper"), c.request("paper")] == [False, False] and c.health()["running"] == ["paper"]
    gate.set()
    t.join(5)
    assert runs == ["paper", "paper"] and c.health() == {"running": [], "errors": {"paper": "x"}}


def test_export_archive_restore(spark, tmp_path):
    rows = spark.createDataFrame([(7, "k7", "T", "", "", "S", "C", "paper", "", None, "kept", ["k"], "s", [])], "id long, canonical_key string, title string, url string, canonical_url string, source_title string, category string, content_kind string, author string, published_at string, status string, keywords array<string>, summary string, references array<struct<title:string,note:string,url:string>>")
    old = spark.createDataFrame([], "path string, text string")
    assert tuple(jobs.exported(rows, old, str(tmp_path)).first()) == (7, "Papers/k7.md", "synced")
    held = spark.createDataFrame([("Papers/k7.md", "not ours")], old.schema)
    assert jobs.exported(rows, held, str(tmp_path)).first().state == "conflict"
    there = jobs.archive(str(tmp_path), "Papers/k7.md", "2025")
    assert (tmp_path / there).exists() and not (tmp_path / "Papers/k7.md").exists()
    jobs.restore(str(tmp_path), there, "Papers/k7.md")
    with pytest.raises(Conflict):
        jobs.restore(str(tmp_path), there, "Papers/k7.md")
