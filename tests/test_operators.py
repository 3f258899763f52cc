import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import counts, filters, joins, merge, paging, ranking


def test_pages_join_to_the_whole_list(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d}" if i % 7 else None, f"2023-05-{1 + i % 28:02d}") for i in range(250)]
    df = spark.createDataFrame(rows, "id long, published_at string, discovered_at string")
    seen, cursor = [], None
    while True:
        found, cursor = paging.page(df, 100, cursor)
        seen += [r.id for r in found]
        if cursor is None:
            break
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[1] or r[2], r[0]), reverse=True)]


def test_cursors():
    assert paging.decode_cursor(paging.encode_cursor("2024", 7)) == ("2024", 7)
    for bad in ("", "!!", paging.encode_cursor("x", "y"), paging.encode_cursor("x", True)):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)


def test_search_has_ascii_case_and_wildcards_only(spark):
    df = spark.createDataFrame([(1, "ÄB c"), (2, "äb"), (3, r"a\b"), (4, None)], "id long, title string")
    assert [r.id for r in filters.search(df, "äB").collect()] == [2]
    assert [r.id for r in filters.search(df, r"a\B").collect()] == [3]
    assert filters.search(df, "  ").count() == 4
    with pytest.raises(ValueError):
        filters.matching(df, filters.EntryFilter(status="other"))


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "text", "", "k", "kept"), (2, "b", "x", "s", None, "read")], "id long, title string, content string, summary string, canonical_key string, status string")
    new = spark.createDataFrame([(1, "", "", "sum", None, "unread"), (3, "c", "y", "", "z", "unread")], old.schema)
    got = {r.id: tuple(r)[1:] for r in merge.upsert(old, new, ["id"], merge.ENTRY_RULES).collect()}
    assert got == {1: ("", "text", "sum", "k", "kept"), 2: ("b", "x", "s", None, "read"), 3: ("c", "y", "", "z", "unread")}


def test_match_prefers_the_guid(spark):
    entries = spark.createDataFrame([(1, 9, "g", "u1", "c1"), (2, 8, "h", "u2", "c2")], "id long, source_id long, guid string, url string, canonical_url string")
    items = spark.createDataFrame([("i", 8, "h", "u1", ""), ("j", 7, "q", "", "c1"), ("k", 7, "r", "", "")], "item string, source_id long, guid string, url string, canonical_url string")
    assert {r.item: r.entry for r in merge.matched_ids(items, entries).collect()} == {"i": 2, "j": 1}


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(f"{x:03d}",) for x in range(200, 0, -1)], "k string").repartition(7)
    assert [(r.id, r.k) for r in merge.with_ids(df, 5, ["k"]).orderBy("id").collect()] == [(5 + i, f"{i + 1:03d}") for i in range(200)]


def test_ids_are_the_same_in_every_run(spark):
    """More rows than a sample for ranges holds, wide and narrow reads of the same plan."""
    df = spark.range(30_000).selectExpr("if(id % 50 = 0, null, md5(cast(id as string))) as k", "id as n", "repeat(md5(cast(-id as string)), 60) as wide").repartition(5)
    numbered = merge.with_ids(df, 1, ["k", "n"])
    expected = {r.n: i + 1 for i, r in enumerate(df.select("k", "n").orderBy("k", "n").collect())}
    for columns in (["id", "n"], ["id", "n", "wide"]):
        assert {r.n: r.id for r in numbered.select(columns).collect()} == expected


def test_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        merge.swapped(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_reconciliation_never_points_to_itself(spark):
    refs = spark.createDataFrame([(1, 10, None, "doi", "x", ""), (2, 11, None, "url", "", "u"), (3, 12, 10, "doi", "x", "")], "id long, citing_entry_id long, cited_entry_id long, scheme string, value string, url string")
    idents = spark.createDataFrame([(10, "doi", "x"), (11, "doi", "x")], "entry_id long, scheme string, value string")
    entries = spark.createDataFrame([(11, "u", ""), (13, "", "u"), (14, "u", "u")], "id long, url string, canonical_url string")
    assert {r.id: r.cited_entry_id for r in joins.reconciled(refs, idents, entries).collect()} == {1: 11, 2: 13, 3: 10}


def test_counts_fill_zeros_and_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, content_kind string, status string")
    assert {tuple(r) for r in counts.by_kind(empty).collect()} == {("paper", 0), ("news", 0)}
    assert counts.by_kind_and_status(empty).count() == 8


def test_worked_ranking_example(spark):
    entries = spark.createDataFrame(
        [(1, 1, "Sparse accelerator", "A chip for sparse matrices.", "Lab Feed", "Chips", "paper"), (2, 1, "Garden notes", "Soil and water for tomatoes.", "Lab Feed", "Chips", "paper"), (3, 1, "Chip scheduling", "Learning to schedule work on a chip.", "Lab Feed", "Chips", "paper")],
        "id long, source_id long, title string, content string, source_title string, category string, content_kind string",
    )
    feedback = spark.createDataFrame([], "entry_id long, profile_id long, label string, updated_at string")
    run = ranking.rescore(entries, ranking.Profile(1, "paper", ("chip design", "machine learning")), feedback)
    got = {r.entry_id: (round(r.score, 4), r.bucket) for r in run.rankings.collect()}
    assert got == {1: (12.4001, "filtered"), 2: (0.0, "filtered"), 3: (34.9448, "relevant")}
    assert (round(run.threshold, 4), run.reason) == (34.9448, "cold-start")
    blocked = ranking.rescore(entries, ranking.Profile(1, "paper", ("chip design",), never=("SCHEDULE",)), feedback)
    assert {r.entry_id: r.bucket for r in blocked.rankings.collect()}[3] == "filtered"
    failing = ranking.rescore(entries, ranking.Profile(1, "paper", ("chip design",)), feedback, embed=lambda *_: 1 / 0)
    assert failing.problems and failing.similarity == "tfidf-v1"


def test_adaptive_threshold(spark):
    scores = [(i, float(s), False, "keep") for i, s in enumerate((60, 55, 50, 45, 40))] + [(9, 42.0, False, "discard")] + [(10 + i, 39.0 - i, False, "discard") for i in range(14)]
    df = spark.createDataFrame(scores, "id long, score double, blocked boolean, label string")
    feedback = df.select(F.col("id").alias("entry_id"), F.lit(1).alias("profile_id"), "label", F.lit("").alias("updated_at"))
    profile = ranking.Profile(1, "paper", ("x",), threshold=38.0)
    assert ranking.choose_threshold(df, profile, feedback) == (40.0, "adaptive-feedback")
    assert ranking.choose_threshold(df, ranking.Profile(1, "paper", ("x",), threshold=20.0), feedback) == (23.0, "adaptive-feedback")
    assert ranking.choose_threshold(df, ranking.Profile(1, "paper", ("x",), threshold=20.0, mode="manual"), feedback) == (20.0, "manual")
    assert ranking.choose_threshold(df.where("false"), ranking.Profile(1, "paper", ("x",)), feedback.where("false"))[0] == 50.0


def test_plans_push_filters_and_prune_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 10").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in plan and "ReadSchema: struct<doc_id:bigint>" in plan


def test_profile_defaults_and_updates():
    base = ranking.Profile(3, "paper", ("x",), threshold=40.0, mode="manual")
    assert [(p.id, p.kind, p.selectivity, p.mode) for p in ranking.with_defaults([base], {"paper": ("a",), "news": ("b",)})] == [(4, "news", "balanced", "auto"), (3, "paper", "balanced", "manual")]
    change = lambda **given: ranking.updated(base, ranking.ProfileUpdate(**given))
    assert (change(interests=("y",)).threshold, change(interests=("y",)).mode) == (None, "auto")
    assert (change(target_precision=0.9).threshold, change(target_precision=0.9).mode) == (40.0, "manual")
    assert (change(exclusions=(), threshold=20.0, threshold_set=True).threshold, change(threshold_set=True).mode) == (20.0, "auto")
    with pytest.raises(ValueError):
        change(interests=())


@pytest.mark.parametrize("limits", [(1 << 17, 1 << 18, 1_000_000, 16), (4, 5, 3, 2)])
def test_sparse_dots_are_those_of_all_weights(spark, monkeypatch, limits):
    """With a null id, a repeated id, texts without terms, and limits so small that there are rare terms and several blocks."""
    for name, limit in zip(("HELD", "BLOCK", "PAIRS", "LANES"), limits):
        monkeypatch.setattr(ranking, name, limit)
    texts = [(i, f"alpha beta{i % 3} beta{i % 3} gamma{i % 7} own{i}") for i in range(20)] + [(None, "alpha gamma1"), (3, "alpha more"), (30, ""), (31, None), (40, "alone")]
    docs = spark.createDataFrame(texts, "id long, t string")
    weights = ranking.tfidf(ranking.term_frequencies(docs, "id", F.col("t")), "id", len(texts))
    expected = ranking.sparse_dot(weights, weights.where("id % 5 = 0").withColumnRenamed("id", "item"), "id", "item").collect()
    got = ranking.sparse_dots(docs, "id", F.col("t"), len(texts), F.col("id") % 5 == 0).collect()
    assert len(got) == len(expected) > 80 and {(r.id, r.item): round(r.dot, 9) for r in got} == {(r.id, r.item): round(r.dot, 9) for r in expected}
    none = docs.where("id < 0")
    assert ranking.sparse_dots(none, "id", F.col("t"), 0, F.col("id") % 5 == 0).collect() == []


def test_sparse_dot_shuffles_no_pairs(spark):
    from inkwell.plans import queries

    plan = queries.queries()["sparse_dot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, item#", plan) and "item#" in plan
