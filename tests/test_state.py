"""What operations leave behind, on small tables with expected results."""

import pytest

from inkwell.operators import state


def test_json_lists_and_maps(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, '["a","b"]'), (2, 'null'), (3, CAST(NULL AS STRING)) AS t(id, v)""")
    assert [r.x for r in rows.select("id", state.json_list(rows.v).alias("x")).orderBy("id").collect()] == [["a", "b"], [], []]
    maps = spark.sql("SELECT map('b', '<1> & 2', 'a', CAST(NULL AS STRING)) AS m, CAST(NULL AS map<string,string>) AS none")
    assert tuple(maps.select(state.sorted_json(maps.m), state.sorted_json(maps.none)).first()) == ('{"a":null,"b":"\\u003c1\\u003e \\u0026 2"}', "{}")


def test_settings_are_replaced_and_read(spark):
    old = spark.createDataFrame([("a", "1", "t0"), ("b", "[2]", "t0")], "key string, value string, updated_at string")
    grown = state.put_settings(old, spark.createDataFrame([(" a ", "7"), ("c", '"x"')], "key string, value string"), "t1")
    assert sorted(map(tuple, grown.collect())) == [("a", "7", "t1"), ("b", "[2]", "t0"), ("c", '"x"', "t1")]
    assert state.get_setting(grown, "b", "array<int>").first().value == [2] and state.get_setting(grown, "z", "int").first() is None
    with pytest.raises(Exception, match="needs a key"):
        state.put_settings(old, spark.createDataFrame([(" ", "7")], "key string, value string"), "t1").collect()


def test_vectors_need_all_parts(spark):
    kind = "content_hash string, model string, dimensions long, vector binary"
    cache = spark.createDataFrame([("h", "m", 1, b"1234", "t0")], kind + ", created_at string")
    grown = state.put_vectors(cache, spark.createDataFrame([("h", "m", 1, b"5678"), ("h", "n", 1, b"1234")], kind), "t1")
    assert sorted((r.model, bytes(r.vector), r.created_at) for r in grown.collect()) == [("m", b"5678", "t1"), ("n", b"1234", "t1")]
    for bad in (("", "m", 1, b"1"), ("h", "", 1, b"1"), ("h", "m", 0, b"1"), ("h", "m", 1, b"")):
        with pytest.raises(Exception, match="needs a hash"):
            state.put_vectors(cache, spark.createDataFrame([bad], kind), "t1").collect()


def test_enrichment_states_are_known(spark):
    entries = spark.createDataFrame([(1, "pending", "t0")], "id long, enrichment_state string, enriched_at string")
    outcome = lambda s: spark.createDataFrame([(1, s, "p", None, None, "doi:x")], "id long, state string, provider string, error string, canonical_url string, canonical_key string")
    row = state.set_enrichment(entries, outcome("failed"), "t1").first()
    assert (row.enrichment_state, row.enriched_at, row.canonical_key) == ("failed", "t0", "doi:x")
    assert state.set_enrichment(entries, outcome("enriched"), "t1").first().enriched_at == "t1"
    with pytest.raises(Exception, match="unknown enrichment state"):
        state.set_enrichment(entries, outcome("odd"), "t1").collect()


def test_summaries_fall_back_with_a_reason(spark):
    entries = spark.createDataFrame([(1, "T", "One. Two."), (2, "T", "One."), (3, "T", "One."), (4, " ", None), (5, "T", "One.")], "id long, title string, content string")
    answers = spark.createDataFrame([(1, " an  answer ", None), (2, " ", None), (3, "x", "timeout"), (4, "x", None)], "id long, generated string, error string")
    got = {r.id: (r.text, r.provider, r.reason) for r in state.summarised(entries, answers, "own", "m").collect()}
    assert got == {1: ("an answer", "own", None), 2: ("One.", "fallback", "empty answer"), 3: ("One.", "fallback", "timeout"), 4: ("No summary is available.", "fallback", "empty content"), 5: ("One.", "fallback", "no answer")}


def test_backfill_counts_what_was_added(spark):
    t = lambda rows, kind: spark.createDataFrame(rows, kind)
    before = {"entries": t([(1, ""), (2, "k")], "id long, canonical_key string"), "identifiers": t([], "id long"), "keywords": t([(1,)], "id long"), "references": t([(1, None), (2, 5)], "id long, cited_entry_id long")}
    after = {"entries": t([(1, "j"), (2, "k")], "id long, canonical_key string"), "identifiers": t([(1,), (2,)], "id long"), "keywords": t([(1,)], "id long"), "references": t([(1, 4), (2, 5)], "id long, cited_entry_id long")}
    assert state.backfill_counts(before, after).first().asDict() == {"entries": 2, "keys_added": 1, "identifiers_added": 2, "keywords_added": 0, "references_linked": 1}
