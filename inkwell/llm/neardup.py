"""Near duplicates: a chosen-path similarity join over MinHash signatures, links confirmed on full shingle sets, and
connected components.

Documents with the same shingle set form a class, and one of them stands for it. In each of ``trees`` independent trees a
node holds the documents that agree on the signature places chosen along its path; a node with more than ``SMALL``
documents branches: the path's hash chooses one or two places (1 / s on average, s the least similarity, 0.85 by default),
and documents go on by their minwise value there. Two documents with similarity s meet at least once in expectation on
every level. Small nodes are
compared exhaustively by signature, and pairs that look similar are confirmed on their full sets:

1. first each document with its best earlier partner and with the node's middle, the member that is most like all others,
   which joins large groups of copies by few pairs;
2. then all pairs of a node that are not in one component yet (other pairs can't change a component), by longer signatures
   of the documents in such nodes;
3. nodes that are still large after ``DEPTH`` levels, or of documents so alike that branching no longer parts them, are cut into pieces that share two members; afterwards every member
   outside the node's largest component is compared with all members, block by block.

No row, pair or node is dropped or capped. Null and empty texts have an empty set and are linked with nothing; rows with a
null id are linked with nothing and get a null component; rows that repeat an id count as one document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import distinct_sorted, finalised, map_texts, shingle_hashes, stored
from inkwell.llm.components import components

PLACES = 64
#: Places of the signatures that the second and third step compare.
LONG = 256
TREES = 10
SMALL = 128
DEPTH = 8
#: The chance that the trees part a pair of the least similarity on all DEPTH levels, were its places independent.
PARTED = 0.0017
#: A pair is confirmed if its agreeing places are at most so many standard deviations under the least similarity.
SURE = 3.4
_SCALE = np.random.default_rng(17).integers(1, 1 << 62, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def likely(places: int, percent: int = 85) -> int:
    """Agreeing places from which a pair may have the similarity: 45 of 64 and 199 of 256 for 0.85, 41 and 184 for 0.80."""
    s = percent / 100
    return int(np.ceil(places * (s - SURE * np.sqrt(s * (1 - s) / places))))


def second_place(percent: int) -> float:
    """The chance of a second place: 0.1765 for 0.85, 0.25 for 0.80."""
    return round(100 / percent - 1, 4)


def trees_for(percent: int) -> int:
    """Trees that part a pair of the least similarity with a chance of PARTED at most: 10 for 0.85, 13 for 0.80."""
    s, c, parted = percent / 100, second_place(percent), 0.0
    for _ in range(DEPTH):
        one = 1 - s + s * parted
        parted = (1 - c) * one + c * one * one
    return TREES if parted <= 0 else max(TREES, int(np.ceil(np.log(PARTED) / np.log(parted))))


def sketches(column: pa.Array, places: int = PLACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: size of its shingle set, two hashes of the set, and its signature (one row of ``places``)."""
    hashes, at = distinct_sorted(*shingle_hashes(column))
    size = np.diff(at)
    some = size > 0
    first, second = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    signature = np.zeros((len(size), places), dtype=np.uint32)
    if some.any():
        begin = at[:-1][some]
        with np.errstate(over="ignore"):
            first[some] = np.add.reduceat(hashes, begin)
            second[some] = np.add.reduceat(finalised(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
            for k in range(places):
                low = np.minimum.reduceat(hashes * _SCALE[k], begin)
                signature[some, k] = (finalised(low) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return size, first, second, signature


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), -1)


def sketch_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def fn(batch: pa.RecordBatch) -> dict:
        size, first, second, signature = sketches(batch.column(1))
        return {"doc_id": batch.column(0), "n_shingles": size, "f1": first.view(np.int64), "f2": second.view(np.int64), "signature": _binary(signature)}

    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], "doc_id long, n_shingles long, f1 long, f2 long, signature binary", fn)


def _long_signatures(texts: DataFrame) -> DataFrame:
    """(doc, signature) of LONG places; one row for each id."""

    def fn(batch: pa.RecordBatch) -> dict:
        return {"doc": batch.column(0), "signature": _binary(sketches(batch.column(1), LONG)[3])}

    return map_texts(texts, ["doc", "text"], "doc long, signature binary", fn).groupBy("doc").agg(F.first("signature").alias("signature"))


# ---- paths ----------------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    return finalised(keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def children(keys: np.ndarray, signature: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """For documents in nodes ``keys``: (row, child node) of each place that the node's path chooses."""
    one = (_mixed(keys, 1) % np.uint64(PLACES)).astype(np.int64)
    two = (_mixed(keys, 2) % np.uint64(PLACES)).astype(np.int64)
    also = ((_mixed(keys, 3) >> np.uint64(11)).astype(np.float64) / 2.0**53 < second) & (one != two)
    rows = np.arange(len(keys))
    out_rows, out_keys = [], []
    for p, r in ((one, rows), (two[also], rows[also])):
        with np.errstate(over="ignore"):
            value = signature[r, p].astype(np.uint64) * np.uint64(0x100000001B3) + p.astype(np.uint64)
            out_keys.append(finalised(finalised(keys[r]) + finalised(value)))
        out_rows.append(r)
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _roots(trees: int) -> np.ndarray:
    return finalised(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _first_level(standing: DataFrame, trees: int, second: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, signature = b.column(0).to_numpy(), _signatures(b.column(1))
            for root in _roots(trees):
                rows, keys = children(np.full(len(doc), root), signature, second)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(doc[rows])], names=["node", "doc"])

    return standing.select("doc", "signature").mapInArrow(run, "node long, doc long")


def _next_level(rows: DataFrame, standing: DataFrame, second: float) -> DataFrame:
    """(node, doc, parent): the children's rows, with the size of the node that they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = children(b.column(0).to_numpy().view(np.uint64), _signatures(b.column(3)), second)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(b.column(c).take(pa.array(rows)) for c in (1, 2))], names=["node", "doc", "parent"])

    return rows.join(standing, "doc").select("node", "doc", "n", "signature").mapInArrow(run, "node long, doc long, parent long")


def _sized(rows: DataFrame, percent: int) -> DataFrame:
    """(node, doc, n, tight) of the rows in nodes of two and more; a node is tight if it kept such a share of its parent's
    documents that they are as similar on average as links are. Sizes are written first: a join of two plain exchanges
    lets Spark split a node that holds a large share of all rows."""
    n = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent")).where("n > 1")
    n = stored(n.select("node", "n", (F.col("n") * 100.0 >= F.col("parent") * float(percent)).alias("tight")), "sizes")
    return rows.join(n, "node").select("node", "doc", "n", "tight")


def nodes(standing: DataFrame, trees: int, second: float, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, doc) of all small nodes, and (node, doc, n) of large ones that are tight or on the last level: in a tight node
    further levels would part few pairs and only repeat its documents."""
    first = _first_level(standing, trees, second).withColumn("parent", F.lit(1 << 62))
    level = stored(_sized(stored(first, "paths"), percent), "nodes")
    small, large = [level.where(F.col("n") <= SMALL).select("node", "doc")], []
    for _ in range(1, DEPTH):
        many = level.where(F.col("n") > SMALL)
        large.append(many.where("tight").select("node", "doc", "n"))
        wide = many.where("not tight").select("node", "doc", "n")
        if wide.limit(1).count() == 0:
            level = level.where("false")
            break
        level = stored(_sized(stored(_next_level(wide, standing, second), "paths"), percent), "nodes")
        small.append(level.where(F.col("n") <= SMALL).select("node", "doc"))
    large.append(level.where(F.col("n") > SMALL).select("node", "doc", "n"))
    return functools.reduce(DataFrame.unionByName, small), functools.reduce(DataFrame.unionByName, large)


def _pieces(large: DataFrame) -> DataFrame:
    """Large nodes cut by a hash of the document; each piece also holds the node's first and last document."""
    parts = F.ceil(F.col("n") * 2 / SMALL).cast("long")
    key = lambda part: F.xxhash64(F.lit(3), F.col("node"), part)
    own = large.select(key(F.pmod(F.xxhash64("doc"), parts)).alias("node"), "doc")
    ends = large.groupBy("node").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("n").alias("n"))
    ends = ends.select("node", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    shared = ends.select(key(F.col("part")).alias("node"), F.explode(F.array("low", "high")).alias("doc"))
    return own.unionByName(shared).distinct()


# ---- comparing ------------------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of batches that hold whole runs of the first column (rows come sorted by it)."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        node = held.column(0).to_numpy()
        if not len(node) or node[0] == node[-1]:
            continue
        cut = int(np.flatnonzero(node[1:] != node[:-1])[-1]) + 1
        yield _columns(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _columns(held)


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    t = t.combine_chunks()
    return t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy(), _signatures(t.column(3))


def similar_pairs(node: np.ndarray, doc: np.ndarray, label: np.ndarray, signature: np.ndarray, every: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, a, b) of pairs that look similar: with ``every`` all of different labels, else each document's best earlier partner and the node's middle."""
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    size = np.diff(np.append(first, len(node)))
    places = signature.shape[1]
    least = likely(places, percent)
    where, left, right = [], [], []
    for s in np.unique(size[size > 1]).tolist():
        begin = first[size == s]
        step = max(1, (1 << 16) // (s * s))
        for at in range(0, len(begin), step):
            place = begin[at : at + step, None] + np.arange(s)
            x = signature[place]
            same = np.zeros((len(place), s, s), dtype=np.int16)
            for k in range(0, places, 16):
                same += (x[:, :, None, k : k + 16] == x[:, None, :, k : k + 16]).sum(3, dtype=np.int16)
            same[:, np.arange(s)[:, None] <= np.arange(s)[None, :]] = 0  # keeps (later, earlier)
            if every:
                lab = label[place]
                g, i, j = np.nonzero((same >= least) & (lab[:, :, None] != lab[:, None, :]))
            else:
                best = same.argmax(2)
                g, i = np.nonzero(np.take_along_axis(same, best[..., None], 2)[..., 0] >= least)
                j = best[g, i]
                if s > 2:  # and with the node's middle, the member that is most like all others
                    both = same + same.transpose(0, 2, 1)
                    middle = both.sum(2).argmax(1)
                    h, k = np.nonzero(np.take_along_axis(both, middle[:, None, None], 2)[..., 0] >= least)
                    g, i, j = np.concatenate((g, h)), np.concatenate((i, k)), np.concatenate((j, middle[h]))
            where.append(node[place[g, 0]])
            left.append(doc[place[g, i]])
            right.append(doc[place[g, j]])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    a, b = np.concatenate(left), np.concatenate(right)
    return np.concatenate(where), np.minimum(a, b), np.maximum(a, b)


def compare(members: DataFrame, marked: DataFrame, every: bool, percent: int) -> DataFrame:
    """(node, a, b): pairs to confirm within the nodes of ``members`` (node, doc); ``marked`` has doc, label, signature.

    A node that holds any similar pair gives a row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            node, a, b = similar_pairs(*group, every, percent)
            differ = a != b
            seen = np.unique(np.column_stack((node[differ], a[differ], b[differ])), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(seen[:, i]) for i in range(3)], names=["node", "a", "b"])

    rows = members.join(marked, "doc").select("node", "doc", "label", "signature")
    return rows.repartition("node").sortWithinPartitions("node", "doc").mapInArrow(run, "node long, a long, b long")


def _rest(large: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Pairs between members of a large node outside its largest component and all its members of other components.

    Members meet in blocks of about 64 (of documents by hash): a row holds two blocks, not two documents. Blocks meet by node and
    block number, so a node of very many members is spread over as many keys as it has blocks. Alike documents share many
    nodes: a pair is given by the least of those that hold both, and if both are outside that node's largest component, by
    the smaller of them, so once."""
    held = large.groupBy("doc").agg(F.collect_set("node").alias("held"))  # as many nodes as the trees give a document
    rows = large.select("node", "doc", "n").join(held, "doc").join(marked, "doc")
    often = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    blocks = F.ceil(F.col("n") / 64).cast("long")
    block = F.pmod(F.xxhash64("doc"), blocks)

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("node", block.alias("block")).agg(F.collect_list(F.struct("doc", "label", "signature", "held")).alias(name), F.max("n").alias("n"))

    often = stored(often, "mains")
    odd = packed(rows.join(often, "node").where("label <> main"), "odd").join(often, "node")
    odd = odd.select("node", "main", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, main, one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                (d, k, x), (e, m, y) = ((v.field(0).to_numpy(), v.field(1).to_numpy(), _signatures(v.field(2))) for v in (one.values, two.values))
                same = np.zeros((len(d), len(e)), dtype=np.int32)
                for at in range(0, x.shape[1], 16):
                    same += (x[:, None, at : at + 16] == y[None, :, at : at + 16]).sum(2, dtype=np.int32)
                once = (m == main)[None, :] | (d[:, None] < e[None, :])
                i, j = np.nonzero((same >= likely(x.shape[1], percent)) & (k[:, None] != m[None, :]) & once)
                if len(i):
                    own, theirs = ([frozenset(h) for h in v.field(3).to_pylist()] for v in (one.values, two.values))
                    first = np.array([min(own[a] & theirs[c]) == node for a, c in zip(i.tolist(), j.tolist())])
                    i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(d[i], e[j])), pa.array(np.maximum(d[i], e[j]))], names=["a", "b"])

    return packed(rows, "all").join(odd, ["node", "block"]).select("node", "main", "odd", "all").mapInArrow(run, "a long, b long")


# ---- confirming -----------------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs of which 100 * intersection >= percent * union on full shingle sets."""
    asked = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()

    def sets(batch: pa.RecordBatch) -> dict:
        hashes, at = distinct_sorted(*shingle_hashes(batch.column(1)))
        raw = hashes.tobytes()
        return {"doc": batch.column(0), "items": [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]}

    wanted = texts.join(asked, "doc", "left_semi")
    held = stored(map_texts(wanted, ["doc", "text"], "doc long, items binary", sets), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                short, long_ = (s, t) if len(s) <= len(t) else (t, s)
                place = np.minimum(np.searchsorted(long_, short), max(len(long_) - 1, 0))
                shared = int((long_[place] == short).sum()) if len(short) else 0
                keep.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = held.select(F.col("doc").alias("a"), F.col("items").alias("left"))
    two = held.select(F.col("doc").alias("b"), F.col("items").alias("right"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, percent: int = 85, trees: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept marks the smallest id of each component."""
    if percent < 80:
        raise ValueError("trees and thresholds are set for similarities of 0.80 and more")
    sketch = stored(sketch_table(df, id_col, text_col), "sketches")
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")
    texts = df.select(df[id_col].cast("long").alias("doc"), df[text_col].alias("text")).where("doc is not null")
    standing = classes.select("doc", "signature")
    small, large = nodes(standing, trees or trees_for(percent), second_place(percent), percent)
    hard = large.limit(1).count() > 0
    members = stored(small.unionByName(_pieces(large)) if hard else small, "members")

    unmarked = standing.withColumn("label", F.col("doc"))
    found = stored(compare(members, unmarked, every=False, percent=percent), "found")
    first = stored(found.select("a", "b").distinct(), "pairs")
    links = stored(confirmed(first, texts, percent), "links")
    labels = components(links)

    known = standing.select("doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("label", "doc").alias("label"))
    near = members.join(stored(found.select("node").distinct(), "near"), "node", "left_semi")  # others hold no similar pair
    groups = near.unionByName(large.select("node", "doc")) if hard else near
    mixed = groups.join(known, "doc").groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("node")
    mixed = stored(mixed, "mixed")
    open_ = near.join(mixed, "node", "left_semi")
    asked = groups.join(mixed, "node", "left_semi").select("doc").distinct()
    longer = stored(_long_signatures(texts.join(asked, "doc", "left_semi")), "longer")

    second = stored(compare(open_, known.join(longer, "doc"), every=True, percent=percent).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = stored(confirmed(second, texts, percent), "links")
    if more.limit(1).count() > 0:
        links = links.unionByName(more)
        labels = components(links)
        known = standing.select("doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("label", "doc").alias("label"))
    if hard:
        third = stored(_rest(large.join(mixed, "node", "left_semi"), known.join(longer, "doc"), percent).join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
        more = stored(confirmed(third, texts, percent), "links")
        if more.limit(1).count() > 0:
            labels = components(links.unionByName(more))
    return _labelled(sketch, classes, labels)


def _labelled(sketch: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("f1", "f2", "n_shingles", F.coalesce("label", "doc").alias("label"))
    rows = sketch.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their columns (rows with a null id stay)."""
    marks = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    return docs.join(marks, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""
