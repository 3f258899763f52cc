"""Near duplicates, decontamination, quality, language model, neighbours and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import EDGES, documents, words
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import ann, contamination, gru, lm, neardup, quality
from inkwell.llm.common import shingle_hashes, word_hashes

LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(w, n, seed):
    rnd = random.Random(seed)
    w = list(w)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def copies(group=150):
    rows = [(i, " ".join(words(120, i))) for i in range(40)]
    base = words(200, 77)
    rows += [(1000 + i, edited(base, i % 9, i)) for i in range(group)]  # a large group around one text, some beyond the limit
    shared = " ".join(words(60, 5))
    rows += [(2000 + i, shared + " " + " ".join(words(60 + i, 500 + i))) for i in range(30)]  # a passage that many hold
    rows += [(3000, "One two three"), (3001, "one  TWO\tthree"), (3002, "one two"), (3003, ""), (3004, None), (3005, "")]
    return rows


def test_hashes_follow_words():
    import pyarrow as pa

    texts = [t for _, t in EDGES] + ["a b", "a  B", "a\0b", "ab"]
    h, at = word_hashes(pa.array(texts))
    seen = {}
    for t, a, b in zip(texts, at, at[1:]):
        w = WORD.findall((t or "").translate(LOW))
        assert len(w) == b - a
        for x, y in zip(w, h[a:b].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    h, at = shingle_hashes(pa.array(texts))
    for t, a, b in zip(texts, at, at[1:]):
        assert len(set(h[a:b].tolist())) == len(shingles(t))


def test_near_duplicates_equal_brute_force(spark):
    rows = copies()
    want = plain_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == want and max(Counter(c for _, c in got.values()).values()) > 50


def test_large_nodes_are_cut_and_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    rows = copies(80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_the_last_step_meets_a_node_of_10_000_members(spark):
    rnd = np.random.default_rng(6)
    n, odd = 10_000, 60
    signature = rnd.integers(0, 1 << 32, (n, neardup.LONG), dtype=np.uint32)
    for i in range(odd):  # members of other components, each like three others
        for k in (5000 + i, 7000 + i, (i + 1) % odd):
            same = rnd.choice(neardup.LONG, 240, replace=False)
            signature[k, same] = signature[i, same]
    label = np.where(np.arange(n) < odd, np.arange(n), 9999)
    rows = [(i, int(label[i]), signature[i].tobytes()) for i in range(n)]
    marked = spark.createDataFrame(rows, "doc long, label long, signature binary")
    large = marked.select(F.lit(1).cast("long").alias("node"), "doc", F.lit(n).cast("long").alias("n"))
    got = neardup._rest(large, marked, 85).collect()
    want = {(min(i, j), max(i, j)) for i in range(odd) for j in np.flatnonzero((signature == signature[i]).sum(1) >= neardup.likely(neardup.LONG)).tolist() if label[i] != label[j]}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) >= 2 * odd


def test_the_stage_drops_copies_from_80_percent(spark, tmp_path):
    rows = []
    for i in range(30):  # 200 words with four changed ones apart: 176 common of 216 shingles, 0.815
        base = words(200, 3000 + i, 4000)
        copy = list(base)
        for k in range(4):
            copy[30 + 45 * k] = f"new{i}x{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    want = {i for i, (_, c) in plain_components(rows, 80).items() if i == c}
    assert len(want) == 30 and len({c for _, c in plain_components(rows, 85).values()}) == 60
    docs = documents(spark, rows)
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).collect()} == want
    assert neardup.keep_one(docs).count() == 60  # op4's own contract stays at 0.85
    assert (neardup.trees_for(85), neardup.trees_for(80), neardup.likely(64), neardup.likely(256)) == (10, 13, 45, 199)


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    rows = neardup.near_duplicates(edge_docs).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert by[8].component_id == 7 and not by[8].kept and by[7].kept and by[1].kept and by[1].n_shingles == 0
    assert by[None].component_id is None
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 7, 9, None]))


def test_decontamination_equals_brute_force(spark, monkeypatch):
    items = [(i, " ".join(words(14 + 3 * i, 900 + i))) for i in range(15)] + [(50, None), (51, ""), (52, "three words only"), (53, " ".join(words(14, 900)))]
    rows = [(i, " ".join(words(50 + 400 * (i % 6), i))) for i in range(60)]
    for i in range(40):
        w = rows[i][1].split()
        part = items[i % 15][1].split()
        if i % 4 == 1:
            part[len(part) // 2] = "changed"
        if i % 4 == 2:
            part = part[: len(part) // 2]
        at = (i * 37) % len(w)
        rows[i] = (i, " ".join(w[:at] + part + w[at:]).upper() if i % 3 else " \n".join(w[:at] + part + w[at:]))
    rows += [(100, "Three WORDS only"), (101, None), (102, "")]
    want = {(d, i): len(q & s) for d, t in rows for s in [shingles(t)] for i, x in items for q in [shingles(x)] if q and len(q & s) >= 0.8 * len(q)}
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for size in (32 << 20, 400):  # the second meets the items in several blocks
        found = contamination.find_items(docs, bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id): r.n_shared for r in found} == want and len(found) == len(want)
    clean = contamination.remove_contaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and clean.columns == docs.columns
    none = bench.where("false")
    assert contamination.find_items(docs, none).count() == 0 and contamination.remove_contaminated(docs, none).count() == len(rows)


def test_decontamination_holds_its_recall_where_an_item_is_cut():
    for n in (12, 60, 80):
        index = contamination.Index([1], [" ".join(f"w{i}" for i in range(n + 4))], 0.8, 0.999999)
        shared = math.ceil(0.8 * n)
        for parts in (1, 2, 4):  # the shared shingles lie evenly in so many full parts
            held = shared / parts
            if held <= contamination.PART:
                miss = (1 - held / (n + contamination.PART - held)) ** (parts * dict(index.classes)[contamination.PART])
                assert miss <= 1e-6


def test_decontamination_of_tiny_and_repeated_items_at_any_threshold(spark):
    rnd = random.Random(12)
    items = [(i % 20, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    items += [(7, items[0][1])] * 3 + [(7, items[1][1])]  # rows that repeat, whole or by id
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(300))) for i in range(40)] + [(100 + i, t) for i, (_, t) in enumerate(items[:10])]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for threshold in (0.8, 0.3, 1.0):
        want = Counter((d, i, len(q & s)) for d, t in rows for s in [shingles(t)] for i, x in items for q in [shingles(x)] if q and len(q & s) >= threshold * len(q) - 1e-9)
        for size in (1 << 28, 20_000):
            found = Counter((r.doc_id, r.item_id, r.n_shared) for r in contamination.find_items(docs, bench, threshold, block_bytes=size).collect())
            assert found == want
    with pytest.raises(ValueError):
        contamination.Index([1], [" ".join(words(5000, 1, 10**6))], 0.001, 0.999999)


def test_an_index_of_many_short_items_is_bounded(spark):
    items = spark.range(30_000).selectExpr("id AS item_id", "array_join(transform(sequence(1, 20), i -> cast(xxhash64(id, i) AS string)), ' ') AS text")
    items = items.unionByName(items.where("item_id = 1").crossJoin(spark.range(2_000).select()))  # and one row that repeats
    blocks = contamination._blocks(items, "item_id", "text", 64 << 20, 0.8, 0.999999)
    assert len(blocks) > 1 and sum(b.agg(F.sum("times")).first()[0] for b in blocks) == 32_000
    import pickle

    assert max(len(pickle.dumps(contamination._index(b, 0.8, 0.999999))) for b in blocks) <= 64 << 20


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "same text here for two rows"), (None, "x")], "item_id long, text string")
    assert [(r.doc_id, r.containment) for r in contamination.find_items(edge_docs, bench).orderBy("doc_id").collect()] == [(7, 1.0), (7, 1.0), (8, 1.0)]
    assert contamination.find_items(no_docs, bench).count() == 0


def test_quality_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1


def test_quality_equals_a_plain_solve(spark):
    """Statistics aside, every step again in plain numpy: moments, ridge on all and on the other fold, bins, least squares under order."""
    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = docs.select("doc_id", "text").toArrow()
    ids = rows.column("doc_id").to_pylist()
    x = quality.statistics(rows.column("text").combine_chunks()).astype(np.float32).astype(float)
    y_of = {r.doc_id: float(r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    own = [i for i, d in enumerate(ids) if d in y_of]
    y, part = np.array([y_of[ids[i]] for i in own]), np.array([zlib.crc32(str(ids[i]).encode()) % 3 for i in own])
    z = quality.Features(x[own].mean(0), x[own].std(0))(x)
    penalty = np.diag([1e-6] + [1.0] * (z.shape[1] - 1))
    ridge = lambda a, b: np.linalg.solve(a.T @ a + penalty, a.T @ b)
    t = z[own]
    other = {k: ridge(t[part != k], y[part != k]) for k in (0, 2)}
    s = np.array([row @ other[k] for row, k in zip(t, part.tolist())])
    place = np.clip(((s + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(place)
    n, sx, sy = (np.bincount(place, v, quality.BINS)[bins] for v in (np.ones(len(s)), s, y))
    # the order-constrained means by their max-min formula, then blocks of equal value
    fit = np.array([max(min(sy[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))])
    blocks = np.flatnonzero(np.concatenate(([True], np.diff(fit) > 1e-12)))
    knots = np.add.reduceat(sx, blocks) / np.add.reduceat(n, blocks)
    want = np.clip(np.interp(z @ ridge(t, y), knots, fit[blocks]), 0, 1)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert max(abs(got[d] - w) for d, w in zip(ids, want)) < 1e-6 and len(set(want.tolist())) > 3


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score_documents(edge_docs, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    assert {r.score for r in quality.score_documents(edge_docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.score_documents(edge_docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.score_documents(no_docs, labels).count() == 0
    assert quality.filter_documents(edge_docs, labels.where("quality = 1")).count() == len(EDGES)


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 4, 1, 2]), np.array([1.0, 4, 4, 2]))
    assert (np.diff(y) >= 0).all() and np.allclose(y, [0, 5 / 8, 1]) and np.allclose(x, [1, 2.5, 4])


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = [t for _, t in EDGES] + ["a b\na b\n\n c", "SHOUT!! IT!!"]
    whole = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(pa.array([t], pa.string()))[0])
    names = dict(zip(quality.NAMES, whole[-2]))
    assert np.isclose(names["distinct_lines"], 2 / 3) and np.isclose(names["distinct_words"], 3 / 5) and np.isclose(names["top_word"], 2 / 5)


def test_lm_base_equals_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 300)  # so that many words take the join
    rows = [(i, " ".join(words(40 + i, i, 800))) for i in range(120)] + [(i, t) for i, t in EDGES if i not in (6, None)]
    rows = [(1000 + k if k >= 120 else i, t) for k, (i, t) in enumerate(rows)]
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, rows)).collect()}
    tokens = {i: WORD.findall((t or "").translate(LOW)) + [""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(w in c for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_lm_score_is_the_chance_of_the_text(spark, monkeypatch):
    """The composed score against a plain walk over each text: the recurrent cell, the class, the member or the tail's share."""
    monkeypatch.setattr(lm, "KNOWN", 600)  # so that there are tail words in the table and others that take the join
    rows = [(i, " ".join(words(30 + i % 50, i, 1500))) for i in range(150)] + [(1000, None), (1001, "unheard of words here"), (1002, " \n ")]
    seen = {}
    train = lm.trained
    monkeypatch.setattr(lm, "trained", lambda learn, vocabulary: seen.update(w=train(learn, vocabulary), v=vocabulary) or seen["w"])
    got = {r.doc_id: r.score for r in lm.score_documents(documents(spark, rows)).collect()}
    tokens = {i: [t.encode() for t in WORD.findall((t or "").translate(LOW))] + [b""] for i, t in rows}
    counts = Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    w, place = {k: v.astype(float) for k, v in seen["w"].items()}, {x: i for i, x in enumerate(seen["v"].words[: gru.VOCAB])}
    tail = {k: [n for x, n in counts.items() if x not in place and lm.tail_class(x) == gru.VOCAB + k] for k in range(gru.TAILS)}
    sigmoid, H = lambda a: 1 / (1 + np.exp(-a)), gru.HIDDEN
    softmax = lambda a: a - np.log(np.exp(a - a.max()).sum()) - a.max()
    for i, text in tokens.items():
        h, before, total = np.zeros(H), gru.BEGIN, 0.0
        for x in text:
            g, u = w["E"][before] @ w["W"] + w["b"], h @ w["U"]
            z, r = sigmoid(g[:H] + u[:H]), sigmoid(g[H : 2 * H] + u[H : 2 * H])
            new = np.tanh(g[2 * H :] + r * u[2 * H :])
            h = (1 - z) * new + z * h
            before = place.get(x, lm.tail_class(x))
            k = before // gru.MEMBERS if before < gru.VOCAB else gru.VOCAB // gru.MEMBERS + before - gru.VOCAB
            total += softmax(h @ w["C"] + w["c"])[k]
            if before < gru.VOCAB:
                total += softmax(h @ w["M"][k] + w["m"][k])[before % gru.MEMBERS]
            else:
                own = tail[before - gru.VOCAB]
                total += math.log((counts.get(x, 0) + 0.1) / (sum(own) + 0.1 * (len(own) + 1)))
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-4, abs_tol=1e-3), i


def test_lm_learns_and_takes_edges(spark, edge_docs, no_docs):
    rows = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.score_documents(edge_docs).count() == len(EDGES) and lm.score_documents(no_docs).count() == 0


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    rows = [(i, f"only{i} " + " ".join(words(20, i))) for i in range(64)]
    given = []
    monkeypatch.setattr(lm, "trained", lambda learn, vocabulary: given.append(learn) or gru.initial(vocabulary.class_log, vocabulary.member_log))
    lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert sorted(r.text for r in given[0].select("text").collect()) == sorted(t for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0)


def test_gru_gradient_and_windows():
    rnd = np.random.default_rng(0)
    w = gru.initial(np.zeros(gru.CLASSES), np.zeros(gru.VOCAB))
    for k in ("C", "M"):
        w[k] = rnd.normal(size=w[k].shape) * 0.3
    w = {k: v.astype(np.float64) for k, v in w.items()}
    texts = [rnd.integers(0, gru.BEGIN, rnd.integers(1, 30)).astype(np.int16) for _ in range(9)]
    target, reset, _ = gru.lanes(texts, 4)
    given = gru._inputs(target, reset)
    loss = lambda w: gru.gradient(w, np.zeros((len(target), gru.HIDDEN)), given.T, target.T, reset.T)
    g, _, total, n = loss(w)
    assert n == sum(map(len, texts))
    for k in w:
        for _ in range(4):
            i = tuple(rnd.integers(0, s) for s in w[k].shape)
            up, down = ({a: b.copy() for a, b in w.items()} for _ in range(2))
            up[k][i] += 1e-3
            down[k][i] -= 1e-3
            slope = (loss(up)[2] - loss(down)[2]) / 2e-3
            assert abs(slope - g[k][i]) < 0.02 * (0.5 + abs(slope))
    scorer = gru.Scorer({k: v.astype(np.float32) for k, v in w.items()})
    whole = scorer.log10(texts, 4, 1000)
    assert np.allclose(whole, scorer.log10(texts, 2, 7), atol=1e-4) and math.isclose(-whole.sum() * math.log(10), total, rel_tol=1e-4)
    assert gru.pack(gru.unpack(gru.pack(w), w)).shape == gru.pack(w).shape


def test_gru_chances_sum_to_one():
    rnd = np.random.default_rng(1)
    w = gru.initial(rnd.normal(size=gru.CLASSES), rnd.normal(size=gru.VOCAB))
    w["M"] = rnd.normal(size=w["M"].shape).astype(np.float32)
    state = rnd.normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.BEGIN)
    assert math.isclose(np.exp(gru.Scorer(w)._output(np.repeat(state, len(every), 0), every)).sum(), 1, rel_tol=1e-4)


def plain_nearest(rows, asked, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            a = ok[q]
            near = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in ok.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=16).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2050, [1.0, 2.0]), (2100, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("ids", F.lit(""))
    asked = [i for i, _ in rows if i % 50 == 0]
    want = plain_nearest(rows, asked)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {q for q, near in want.items() if near}
    hits = sum(len({i for i, _ in want[q]} & {i for _, i, _ in near}) for q, near in got.items())
    assert hits >= 0.9 * sum(len(near) for near in want.values())
    for q in (0, 1000, 1050):  # copies: ties go to the smaller id, the own id is left out
        assert [i for _, i, _ in got[q]] == [i for i, _ in want[q]]
    scores = {q: dict(near) for q, near in plain_nearest(rows, asked, 10**6).items()}
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1)) and all(abs(scores[q][i] - s) < 1e-12 for _, i, s in near)
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0 and ann.nearest(df, df.where("false")).count() == 0


def test_neighbours_are_never_fewer_than_there_are(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, (1 if i % 2 else -1) * np.eye(16)[0] + 0.1 * rnd.normal(size=16)) for i in range(8)]  # two opposite bundles
    rows += [(50 + i, rnd.normal(size=40)) for i in range(4)]  # a rare length with few candidates
    rows = [(i, v.tolist()) for i, v in rows] + [(100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(q, k + 1, i) for q, near in plain_nearest(rows, [i for i, _ in rows]).items() for k, (i, _) in enumerate(near)}
    assert {(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df).collect()} == want and len(want) == 8 * 5 + 4 * 3


@pytest.mark.parametrize("n", [1, 2, 6])
def test_neighbours_of_small_tables(spark, n):  # with six vectors every candidate is returned
    rnd = np.random.default_rng(n)
    for vectors in (rnd.normal(size=(n, 64)), np.eye(n), np.ones((n, 2)) * np.arange(1, n + 1)[:, None]):  # random, orthogonal, of one direction
        rows = [(50 * i, v.tolist()) for i, v in enumerate(vectors)]
        rows += [rows[0]] * 3  # repeated rows count once
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want = plain_nearest(dict(rows).items(), [i for i, _ in rows])
        got = {}
        for r in ann.nearest(df, df).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert {q: len(v) for q, v in got.items()} == {q: min(5, n - 1) for q in dict(rows) if n > 1}
        for q, near in got.items():
            assert [i for i, _ in near] == [i for i, _ in want[q]] and np.allclose([s for _, s in near], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_an_id_with_several_vectors_counts_with_the_least(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (1, [0.5, -1.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (50, [0.0, 1.0]), (50, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = [(0, [1.0, 0.0]), (1, [0.5, -1.0]), (2, [1.0, 1.0]), (50, [0.0, -1.0])]
    want = {(q, k + 1, i) for q, near in plain_nearest(once, [0, 1, 2, 50]).items() for k, (i, _) in enumerate(near)}
    assert {(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df).collect()} == want


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e300, -9e299]), (2, [3e-300, 1e-300]), (3, [1.0, 2.0]), (4, [-1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    want = plain_nearest(scaled, [i for i, _ in rows])
    got = {}
    for r in ann.nearest(df, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near] and np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=0, atol=1e-12)


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    held = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = plain_nearest(held, [i for i, _ in held if i % 50 == 0])
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Each stage against plain Python on what the one before kept."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, path).cache()
    scored = quality.score_documents(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()} and good.columns == docs.columns
    one = stages["near_duplicates"](spark, good, path).cache()
    kept = {i for i, (_, c) in plain_components([(r.doc_id, r.text) for r in good.collect()], 80).items() if i == c}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    items = [shingles(r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, one, path).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if not any(len(q & s) >= 0.8 * len(q) for s in [shingles(r.text)] for q in items)}
    safe = stages["secrets"](spark, clean, path).cache()
    from test_spans import plain_secrets

    assert not any(plain_secrets(r.text) for r in safe.collect()) and all(r.n_chars == len(r.text) for r in safe.collect()) and safe.columns == docs.columns
    last = stages["encoding"](spark, safe, path).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in last) == sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect())


@pytest.mark.parametrize("clash", [False, True])
def test_stages_take_edges(spark, tmp_path, clash):
    docs = documents(spark, EDGES, clash=clash)
    spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this is there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= table.count()


@pytest.mark.parametrize("n", [1, 50])
def test_components_of_a_path(spark, n):
    from inkwell.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}


@pytest.mark.parametrize("size", [0.5, 40.0])
def test_gru_output_with_small_and_very_large_logits(size):
    """Exponentials are taken without a shift only where no state can give logits out of their range; tokens over several parts."""
    rnd = np.random.default_rng(5)
    w = {k: v.astype(np.float32) for k, v in gru.initial(np.zeros(gru.CLASSES), np.zeros((gru.VOCAB // gru.MEMBERS, gru.MEMBERS))).items()}
    w |= {k: (rnd.normal(size=w[k].shape) * size).astype(np.float32) for k in ("C", "M")}
    assert gru._within(w["C"], w["c"]) == gru._within(w["M"], w["m"]).all() == (size < 1)
    n = gru.PART + 77
    s, y = rnd.uniform(-1, 1, (n, gru.HIDDEN)).astype(np.float32), rnd.integers(-1, gru.VOCAB + gru.TAILS, n)
    live = np.flatnonzero(y >= 0)
    kind, member = gru._classes(y)
    log_softmax = lambda x: x - x.max(-1, keepdims=True) - np.log(np.exp(x - x.max(-1, keepdims=True)).sum(-1, keepdims=True))
    wide = s.astype(float)
    expected = log_softmax(wide @ w["C"])[np.arange(n), kind]
    for i in np.flatnonzero(member >= 0):
        expected[i] += log_softmax(wide[i] @ w["M"][kind[i]])[member[i]]
    assert np.allclose(gru.Scorer(w)._output(s[live], y[live]), expected[live], rtol=1e-4, atol=1e-3)
    g, back = {k: np.zeros_like(v) for k, v in w.items()}, np.zeros_like(s)
    loss, tokens = gru._output_gradient(w, s, y, back, g, gru.Space())
    assert tokens == len(live) and np.isclose(loss, -expected[live].sum(), rtol=1e-4)
    assert all(np.isfinite(v).all() for v in (*g.values(), back)) and abs(float(g["c"].sum())) < 0.1 and not back[y < 0].any()


def test_lm_words_of_slices(spark):
    """A batch is cut into slices whose first text lies within the batch's bytes; every slice gives its own words."""
    import pyarrow as pa

    texts = [" ".join(words(300, i)).upper() + " Ünï É" for i in range(1500)]
    texts[701] = ""
    some = [None if i == 700 else t for i, t in enumerate(texts)]  # Arrow copies a slice that holds a null, not one without
    texts[700] = ""
    expected = [[x.encode() for x in WORD.findall(t.translate(LOW))] for t in texts]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(some)):
        for a, n in ((0, 1500), (1, 1), (400, 500), (700, 2), (1499, 1), (20, 0)):
            found, at = lm.words_of(column.slice(a, n))
            flat = found.to_pylist()
            assert [flat[i:j] for i, j in zip(at, at[1:])] == expected[a : a + n]
    counts = Counter(w for x in expected for w in [*x, b""])
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert {bytes(r.word): r.n for r in lm.count_words(rows).collect()} == counts


def test_lm_reader_and_groups(spark, monkeypatch):
    """Symbols, places and tail classes equal a plain walk over the words; texts scored in small groups score as in one."""
    import pyarrow as pa

    some = [b"", b"x", b"xy", "é".encode(), b"\xff", b"abc\x00", b"zz"]
    assert lm.tail_classes(pa.array(some, pa.large_binary()).slice(1)).tolist() == [lm.tail_class(x) for x in some[1:]]
    assert lm.tail_classes(pa.array([], pa.large_binary())).tolist() == [] and lm.tail_classes(pa.array([b""], pa.large_binary())).tolist() == [lm.tail_class(b"")]
    rows = [(i, " ".join(words(20 + i % 90, i))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(["", None, "only once", " x "])]
    monkeypatch.setattr(lm, "KNOWN", 600)
    seen, train = {}, lm.trained
    monkeypatch.setattr(lm, "trained", lambda learn, v: seen.setdefault("w", train(learn, seen.setdefault("v", v))))
    whole = {r.doc_id: r.score for r in lm.score_documents(documents(spark, rows)).collect()}
    monkeypatch.setattr(lm, "trained", lambda learn, v: seen["w"])
    monkeypatch.setattr(lm, "READ", 2000)
    monkeypatch.setattr(lm, "GROUP", 3000)
    parts = {r.doc_id: r.score for r in lm.score_documents(documents(spark, rows)).collect()}
    assert whole.keys() == parts.keys() and all(math.isclose(whole[i], parts[i], rel_tol=1e-4) for i in whole)
    place = {x: i for i, x in enumerate(seen["v"].words)}
    symbols, starts, places, others = seen["v"].reader().read(pa.array([t for _, t in rows]))
    names = others.to_pylist()
    for k, (_, t) in enumerate(rows):
        tokens = [*(x.encode() for x in WORD.findall((t or "").translate(LOW))), b""]
        own = places[starts[k] : starts[k + 1]].tolist()
        assert [names[-1 - p] if p < 0 else seen["v"].words[p] for p in own] == tokens and all((p < 0) == (x not in place) for p, x in zip(own, tokens))
        assert symbols[k].tolist() == [place[x] if place.get(x, gru.VOCAB) < gru.VOCAB else lm.tail_class(x) for x in tokens]
