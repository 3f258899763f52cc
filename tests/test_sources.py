import json

import pytest
from pyspark.sql import functions as F

from inkwell.schema import ENTRIES, SOURCES, backfilled, checked, migrated
from inkwell.sources import feeds, manifest, markup, notes, providers
from inkwell.streaming import ingest

RSS = b"""<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><title>T</title>
<item><title>One &amp; <b>two</b></title><link>https://example.org/1?utm_source=x</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate>
<description><![CDATA[<p>Caf\xe9 <b>bold</b></p>]]></description><dc:creator xmlns:dc="d">A B</dc:creator></item>
<item><guid>g2</guid><description>plain</description></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i1</id><title>X</title><link rel="self" href="https://e.org/s"/><link href="https://e.org/a"/>
<author><name>P</name></author><author><name>Q</name></author><updated>2024-01-01</updated><published>2023-01-01</published>
<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p z="2" a="1">hi</p></div></content></entry></feed>"""
RDF = b"""<rdf:RDF xmlns:rdf="r" xmlns="p"><channel><title>c</title></channel><item><title>R</title><link>https://e.org/r</link></item></rdf:RDF>"""


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, RDF), (4, b"<rss>&nbsp;</rss>"), (5, None), (6, b"<html></html>"), (7, b"<?xml version='1.0' encoding='koi8-r'?><rss/>")], "source_id long, document binary")
    rows = {(r.source_id, r.position): r for r in feeds.read_items(df).collect()}
    one, two, atom, rdf = (rows[k] for k in ((1, 0), (1, 1), (2, 0), (3, 0)))
    assert (one.guid, one.url, one.title, one.author, one.published_at) == ("https://example.org/1", "https://example.org/1", "One & two", "A B", "2024-03-05T10:00:00+00:00")
    assert one.content_markdown == "Café **bold**" and one.content == "Café bold"
    assert (two.guid, two.title) == ("g2", "Untitled")
    assert (atom.url, atom.author, atom.published_at, atom.content) == ("https://e.org/a", "P, Q", "2023-01-01T00:00:00+00:00", "hi")
    assert (rdf.title, rdf.guid) == ("R", "https://e.org/r")
    assert {r.source_id for r in feeds.read_errors(df).collect()} == {4, 6, 7}


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<h2>A <em>b</em></h2><p>c<br>d", "## A *b*\n\nc\nd"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("<ol><li>x<li></ol>", "1. x\n2."),
        ("<table><tr><td>1<td>a|b<tr><th>h</table>", "| h |  |\n| --- | --- |\n| 1 | a\\|b |"),
        ("<pre><code class='a language-py'>x = 1\n</code></pre>", "```py\nx = 1\n```"),
        ("<code>a`b</code> <mark>m</mark> <s>n</s>", "``a`b`` ==m== ~~n~~"),
        ("<a href='javascript:x'>bad</a> <a href='/p q'>ok</a> <img src='x.png' alt='i'>", "bad [ok](</p%20q>)"),
        ("<script>x</script><p>y</p><svg><p>z</p></svg>", "y"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n>\n>\n> b"),
        ("plain *text* <input>", "plain *text* <input>"),
        ("<strong></strong><blockquote></blockquote>", ""),
        ("", ""),
    ],
)
def test_markdown(html, expected):
    assert markup.to_markdown(html) == expected


def test_markdown_of_deep_markup_falls_back():
    assert markup.to_markdown("<div>" * 3000 + "x") in ("x", "")
    assert markup.safe_link("b?x=%20", "https://e.org/a/") == "https://e.org/a/b?x=%20"
    assert markup.plain_text("<p>a <a>link</a>.</p>") == "a link ."


def test_discovery_and_citations():
    page = "<html><head><link rel=stylesheet href=x><link rel='ALTERNATE x' type='application/atom+xml' href='../f?utm_source=a'></head>"
    assert feeds.discover(page, "https://e.org/a/b") == "https://e.org/f?utm_source=a"
    assert feeds.discover("<link rel=alternate type=application/rss+xml href='ftp://x/y'>", "https://e.org/") == ""
    c = feeds.citation("<title> A  b </title><meta name=citation_author content='X &amp; Y'><meta property=keywords content='k1, k2;k3'><link rel=canonical href='http://e.org/'>", "https://e.org/p")
    assert (c["title"], c["authors"], c["keywords"], c["url"]) == ("A b", ["X & Y"], ["k1", "k2", "k3"], "https://e.org/p")


def listing(**change):
    row = {"title": "T", "url": "https://e.org/f", "category": "C", "content_kind": "news"} | change
    return json.dumps({"format": manifest.FORMAT, "version": 1, "sources": [row]})


@pytest.mark.parametrize("change", [{"title": " "}, {"title": 3}, {"url": "ftp://e.org"}, {"url": "https://u@e.org/"}, {"url": "https://e.org:81/"}, {"url": "https://e.org:x/"}, {"category": "x" * 201}, {"content_kind": "blog"}, {"enabled": "yes"}, {"more": 1}, {"url": "https://e.org/" + "x" * 2048}])
def test_bad_manifests(spark, change):
    with pytest.raises(manifest.ManifestError):
        manifest.validated(spark, listing(**change))


def test_manifest(spark):
    for bad in ("{", "[]", json.dumps({"format": "x", "version": 1, "sources": []}), json.dumps({"format": manifest.FORMAT, "version": True, "sources": []})):
        with pytest.raises(manifest.ManifestError):
            manifest.read(spark, bad)
    seed = manifest.validated(spark, manifest.SEED)
    assert seed.count() == 48 and seed.where("content_kind = 'paper'").count() == 11
    twice = json.loads(listing())
    twice["sources"].append(twice["sources"][0] | {"url": "HTTPS://e.org:443/f#x"})
    with pytest.raises(manifest.ManifestError, match="duplicate"):
        manifest.validated(spark, json.dumps(twice))
    table, tally = manifest.import_into(seed, manifest.validated(spark, listing()))
    assert (table.count(), tuple(tally.first())) == (49, (1, 0, 0))
    assert manifest.validated(spark, manifest.export(table)).count() == 49


def test_providers(spark):
    graph = json.dumps({"paperId": "AB", "externalIds": {"DOI": "10.1000/X", "ArXiv": "2101.00001"}, "title": " A  b", "abstract": "t", "authors": [{"name": "P"}, {"name": "Q"}], "year": 2021, "fieldsOfStudy": ["CS", "CS"], "references": [{"title": "none"}, {"paperId": "C", "title": "c"}, {"externalIds": {"DOI": "10.1000/y"}}]})
    registry = json.dumps({"message": {"title": ["T"], "author": [{"given": "A", "family": "B"}], "abstract": "<jats:p>x</jats:p>", "published": {"date-parts": [[2020, 5]]}, "subject": [], "reference": [{"DOI": "10.1000/Z"}, {"article-title": "n"}]}})
    df = spark.createDataFrame([(1, graph), (2, None)], "id int, j string")
    g = providers.graph_metadata(df, "id", "j").orderBy("id").first()
    assert (g.title, g.author, g.published_at, g.doi, g.arxiv, g.topics) == ("A b", "P, Q", "2021-01-01T00:00:00+00:00", "10.1000/x", "2101.00001", ["CS"])
    assert [(r.scheme, r.value) for r in g.refs] == [("s2", "c"), ("doi", "10.1000/y")]
    r = providers.registry_metadata(spark.createDataFrame([(1, registry)], "id int, j string"), "id", "j").first()
    assert (r.abstract, r.author, r.published_at, [x.value for x in r.refs]) == ("x", "A B", "2020-05-01T00:00:00+00:00", ["10.1000/z"])


def test_request_repeats_and_remembers():
    calls, now = [], [0.0]

    def fetch(key):
        calls.append(key)
        if len(calls) == 1:
            raise TimeoutError
        return "v"

    request = providers.Request(fetch, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [request("a"), request("a")] == ["v", "v"] and len(calls) == 2 and now[0] >= 1
    now[0] += 8 * 86400
    assert request("a") == "v" and len(calls) == 3


def test_notes(spark, tmp_path):
    rows = spark.createDataFrame([(7, "doi:10.1/x", 'A "q" [t]', "https://e.org", "", "S", "Big & small", "paper", "me", None, "kept", ["k"], "one\n\ntwo", [("T]x", "Papers/y", ""), ("U", None, "https://u"), ("V", None, "")])], "id long, canonical_key string, title string, url string, canonical_url string, source_title string, category string, content_kind string, author string, published_at string, status string, keywords array<string>, summary string, references array<struct<title:string,note:string,url:string>>")
    out = notes.rendered(rows)
    r = out.first()
    assert r.path == "Papers/doi 10.1 x.md" and 'title: "A \\"q\\" [t]"' in r.properties and '  - "big-and-small"' in r.properties
    assert "> one\n>\n> two" in r.body and "- [[Papers/y|T x]]" in r.body and "- [U](<https://u>)" in r.body and "- V" in r.body
    notes.write(out, str(tmp_path))
    target = tmp_path / "Papers" / "doi 10.1 x.md"
    mine = target.read_text() + "my own words\n"
    merged = out.withColumn("title", F.lit("New")).select(notes.merged(F.lit(mine), F.lit("P"), F.lit("B"), F.col("text")).alias("m")).first().m
    assert merged.text.endswith("my own words\n") and "\nP\n" in merged.text and merged.conflict is None
    assert out.select(notes.merged(F.lit("other"), F.lit("P"), F.lit("B"), F.col("text")).alias("m")).first().m.conflict
    with pytest.raises(Exception, match="unsafe path"):
        notes.write(out.withColumn("path", F.lit("../x.md")), str(tmp_path))
    assert [notes.formatted(x) for x in (1.0, 0.1, 1e-7)] == ["1.0", "0.1", "1e-7"]


def test_schema(spark):
    old = spark.createDataFrame([(1, "t")], "id long, title string")
    row = migrated(old, SOURCES).first()
    assert (row.category, row.enabled, row.etag) == ("Unsorted", True, None)
    fixed = backfilled(migrated(spark.createDataFrame([(1, "u", "now")], "id long, url string, discovered_at string"), ENTRIES))
    assert (fixed.first().canonical_url, fixed.first().updated_at) == ("u", "now") and backfilled(fixed).collect() == fixed.collect()
    with pytest.raises(Exception, match="unknown kind"):
        spark.createDataFrame([("x",)], "k string").select(checked(F.col("k"), ("a",), "kind")).collect()


def test_stream_merges_what_lands(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "entries")
    landing.mkdir()
    item = {"source_id": 1, "guid": "g", "url": "https://e.org/1", "canonical_url": "https://e.org/1", "title": "T", "author": "", "published_at": "2024", "content": "Text.", "content_kind": "news", "arrived": "1"}
    (landing / "a.json").write_text("\n".join(json.dumps(item | x) for x in ({}, {"title": "T2", "arrived": "2"}, {"guid": "h", "url": "https://e.org/2", "canonical_url": "https://e.org/2"})))
    ingest.run(spark, str(landing), table, str(tmp_path / "cp"), "2025-01-01T00:00:00+00:00")
    (landing / "b.json").write_text(json.dumps(item | {"source_id": 2, "guid": "other", "title": "T3", "content": "", "arrived": "3"}))
    for _ in range(2):
        ingest.run(spark, str(landing), table, str(tmp_path / "cp"), "2025-01-02T00:00:00+00:00")
    rows = {r.guid: r for r in spark.read.parquet(table).collect()}
    assert set(rows) == {"g", "h"} and rows["g"].title == "T3" and rows["g"].content == "Text." and sorted(r.id for r in rows.values()) == [1, 2]
