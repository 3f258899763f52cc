"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing over a sharded index.

Vectors are scaled to length one, where the nearest by Euclid's distance are the nearest by cosine. Equal vectors form a
class; each class keeps its smallest ids, one more than the neighbours asked for, which is all that ties can ever need.
Classes are dealt to shards of about ``SHARD`` by a hash, so no shard depends on how vectors cluster. A shard builds
``TABLES`` hash tables, each of ``HASHES`` functions floor((a.x + b) / WIDTH) with Gaussian a. A query visits its own bucket and
the ``PROBES`` perturbed buckets of the highest estimated success in each table; the candidates of all tables are merged and
reranked by their exact cosine. Queries go to all shards in packed blocks, and the shards' best are merged. A query whose
buckets hold fewer candidates than were asked for, though its length has more, is compared with all vectors of that length.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of another length than a query's
are no candidates of it. Ties go to the smaller id. An id counts once: where its rows hold several vectors, with the least of
them (component by component, a shorter vector before its extensions). Components of any size that a double holds are fine:
vectors are scaled by a power of two before they are squared.

The index is dealt out evenly, one task for each shard; work is queries times candidates, so it grows with the square of the
table where the queries are a fixed share of it.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import stored

SHARD = 8192
BLOCK = 1024
TABLES, HASHES, WIDTH, PROBES = 16, 8, 2.0, 64


@functools.cache
def probe_sets(hashes: int, probes: int) -> np.ndarray:
    """The perturbations worth most in expectation, as rows of flags over a query's 2 * hashes slot borders sorted by
    distance. A set may not cross both borders of one slot (borders j and 2 * hashes + 1 - j, in expectation)."""
    m = hashes
    j = np.arange(1, m + 1)
    cost = np.concatenate((j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) / (m + 1) + (2 * m + 1 - np.arange(m + 1, 2 * m + 1)) * (2 * m + 2 - np.arange(m + 1, 2 * m + 1)) / (4 * (m + 1) * (m + 2))))
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < probes:
        c, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - x in chosen for x in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*chosen, last + 1)))
    flags = np.zeros((len(out), 2 * m))
    for i, chosen in enumerate(out):
        flags[i, list(chosen)] = 1
    return flags


class Tables:
    """The hash tables of one shard's unit vectors."""

    def __init__(self, unit: np.ndarray, seed: int = 23) -> None:
        self.unit = unit
        rnd = np.random.default_rng((seed, unit.shape[1]))
        self.a = rnd.normal(size=(TABLES, unit.shape[1], HASHES))
        self.b = rnd.uniform(0, WIDTH, (TABLES, HASHES))
        self.scale = rnd.integers(1, 1 << 40, (TABLES, HASHES)) * 2 + 1
        self.order, self.keys, self.start = [], [], []
        for t in range(TABLES):
            key = np.floor((unit @ self.a[t] + self.b[t]) / WIDTH).astype(np.int64) @ self.scale[t]
            order = np.argsort(key, kind="stable")
            keys, start = np.unique(key[order], return_index=True)
            self.order.append(order)
            self.keys.append(keys)
            self.start.append(np.append(start, len(key)))

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Flags (query, vector) of the vectors in visited buckets."""
        found = np.zeros((len(queries), len(self.unit)), dtype=bool)
        flags = probe_sets(HASHES, PROBES)
        for t in range(TABLES):
            place = (queries @ self.a[t] + self.b[t]) / WIDTH
            slot = np.floor(place)
            below = place - slot
            distance = np.hstack([below, 1 - below])
            move = np.hstack([-self.scale[t], self.scale[t]])
            rank = np.argsort(distance, axis=1)
            moved = move[rank]  # what crossing the r-th nearest border adds to the key
            base = slot.astype(np.int64) @ self.scale[t]
            keys = np.column_stack((base, base[:, None] + moved @ flags.T.astype(np.int64)))
            at = np.minimum(np.searchsorted(self.keys[t], keys), len(self.keys[t]) - 1)
            hit_q, hit_p = np.nonzero(self.keys[t][at] == keys)
            bucket = at[hit_q, hit_p]
            size = self.start[t][bucket + 1] - self.start[t][bucket]
            first = np.repeat(self.start[t][bucket] - (np.cumsum(size) - size), size)
            found[np.repeat(hit_q, size), self.order[t][first + np.arange(size.sum())]] = True
        return found


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(fine)


def _distinct_ids(rows: DataFrame) -> DataFrame:
    """One vector for each id. Only ids that repeat (counted first, without their vectors) meet in an aggregation."""
    again = stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    if again.limit(1).count() == 0:
        return rows
    return rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")))


def _key():
    """128 bits of hash and the length: what equal vectors share."""
    return F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(7), "vector").alias("g"), F.size("vector").alias("n")).alias("key")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(key, vector, ids): the distinct vectors and the k + 1 smallest ids of each, cut in two steps so that a vector with
    very many copies never meets in one task."""
    keyed = rows.select(_key(), "id", "vector").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)))
    first = Window.partitionBy("key", "part").orderBy("id")
    few = keyed.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    return few.groupBy("key").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.first("vector").alias("vector"))


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``df`` of the largest cosine found, its own id left out."""
    classes = stored(_classes(_distinct_ids(usable(df, id_col, vector_col)), k), "classes")
    n = classes.count()
    shards = max(1, -(-n // SHARD))
    asked = _distinct_ids(usable(queries, id_col, vector_col))
    keyed = asked.select(F.col("id").alias("query_id"), _key(), "vector")
    keyed = stored(keyed, "queries")
    # equal query vectors are searched once: k + 1 candidates by class serve them all
    distinct = stored(keyed.groupBy("key").agg(F.first("vector").alias("vector")), "asked")
    blocks = max(1, -(-distinct.count() // BLOCK))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    none = F.lit(None)
    index_rows = classes.select(shard.alias("shard"), F.lit(-1).alias("block"), "key", "ids", "vector")
    key_type = classes.schema["key"].dataType.simpleString()
    one = distinct.select(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(blocks)).cast("int").alias("block"), "key", none.cast("array<bigint>").alias("ids"), "vector")
    query_rows = one.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "key", "ids", "vector")
    best = stored(_searched(index_rows, query_rows, shards, key_type, k, every=False), "best")
    # k + 1 ids, the query's own among them, or all that its length has
    has = classes.groupBy(F.col("key.n").alias("n")).agg(F.sum(F.size("ids")).alias("has"))
    short = distinct.select("key").join(best.select("key", F.size("all").alias("got")), "key", "left").join(has, F.col("key.n") == F.col("n"))
    short = stored(short.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), F.col("has"))).select("key", "n"), "short")
    if short.limit(1).count() > 0:
        few = index_rows.join(short.select("n").distinct(), F.col("key.n") == F.col("n"), "left_semi")
        exact = _searched(few, query_rows.join(short.select("key"), "key", "left_semi").select(query_rows.columns), shards, key_type, k, every=True)
        best = best.join(short.select("key"), "key", "left_anti").unionByName(stored(exact, "exact"))
    own = keyed.select("query_id", "key").join(best, "key")
    kept = F.slice(F.filter("all", lambda x: x["i"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(kept).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _searched(index_rows: DataFrame, query_rows: DataFrame, shards: int, key_type: str, k: int, every: bool) -> DataFrame:
    """(key, all): the merged best of each query's shards, found by the hash tables or, with ``every``, among all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list[pa.Table] = []
        tables: dict[int, tuple[Tables | None, pa.Array, np.ndarray, np.ndarray]] = {}
        for block, rows in _runs(batches):
            if block < 0:
                index.append(rows)
                continue
            if index:  # a task holds one shard, its index rows first
                tables = _built(pa.concat_tables(index), every)
                index = []
            yield from _answers(rows, tables, k, every)

    rows = index_rows.unionByName(query_rows).repartitionById(shards, F.col("shard")).sortWithinPartitions("block")
    found = rows.mapInArrow(run, f"key {key_type}, ids array<bigint>, scores array<double>")
    best = found.select("key", F.explode(F.arrays_zip("scores", "ids")).alias("x")).groupBy("key").agg(F.collect_list(F.struct((-F.col("x.scores")).alias("s"), F.col("x.ids").alias("i"))).alias("all"))
    return best.select("key", F.array_sort("all").alias("all"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one block at a time, BLOCK of them at most, from batches sorted by block."""
    for batch in batches:
        block = batch.column(1).to_numpy()
        edge = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)])) if len(block) else []
        for a, b in zip(edge[:-1], edge[1:]):
            for at in range(int(a), int(b), BLOCK):
                yield int(block[at]), pa.Table.from_batches([batch.slice(at, min(BLOCK, int(b) - at))])


def _vectors(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the length, the rows that have it, and the vectors, scaled by powers of two so that no
    square overflows (a cosine stays what it is, to the last bit)."""
    lists = rows.column("vector").combine_chunks()
    size = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy()
    start = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        x = values[start[own][:, None] + np.arange(n)]
        yield n, own, np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _built(index: pa.Table, every: bool) -> dict[int, tuple[Tables | None, pa.Array, np.ndarray, np.ndarray]]:
    """The tables of a shard, by vector length (none where every vector is a candidate)."""
    out, ids = {}, index.column("ids").combine_chunks()
    for size, own, x in _vectors(index):
        norm = np.sqrt((x**2).sum(1))
        out[size] = (None if every else Tables(x / norm[:, None]), ids.take(pa.array(own)), x, norm)
    return out


def _answers(asked: pa.Table, tables: dict, k: int, every: bool) -> Iterator[pa.RecordBatch]:
    """For each query its k + 1 best ids in the shard (the query's own id may be one of them)."""
    answered, ids, scores = [], [], []
    for size, own, q in _vectors(asked):
        if size not in tables:
            continue
        table, members, x, norm = tables[size]
        q_norm = np.sqrt((q**2).sum(1))
        found = None if every else table.candidates(q / q_norm[:, None])
        for i in range(len(q)):
            at = np.arange(len(x)) if every else np.flatnonzero(found[i])
            if not len(at):
                continue
            score = (x[at] * q[i]).sum(1) / (norm[at] * q_norm[i])
            # classes enough that their ids make k + 1, ties at the border included
            if len(at) > k + 1:
                border = np.partition(score, len(score) - (k + 1))[len(score) - (k + 1)]
                near = np.flatnonzero(score >= border)
            else:
                near = np.arange(len(at))
            pairs = sorted((-float(score[j]), v) for j in near for v in members[int(at[j])].as_py())[: k + 1]
            answered.append(int(own[i]))
            ids.append([v for _, v in pairs])
            scores.append([-s for s, _ in pairs])
    if answered:
        keys = asked.column("key").combine_chunks().take(pa.array(answered))
        yield pa.RecordBatch.from_arrays([keys, pa.array(ids, type=pa.list_(pa.int64())), pa.array(scores, type=pa.list_(pa.float64()))], names=["key", "ids", "scores"])
