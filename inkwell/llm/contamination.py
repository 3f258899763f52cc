"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Documents are cut into parts of at most ``PART`` five-word shingles, and items are classed by the size of their shingle sets, each
class with as many hash functions as its matches need: an item of n shingles of which s must lie in the text shares a minimum
under one function with a part that holds h of them with a chance of h / (n + PART) at least, and the parts' h add up to s; so
with -ln(1 - recall) * (n + PART) / s functions, however the parts cut it, it shares a minimum with one of them with a
probability of ``recall`` at least (one agreeing minimum makes a candidate). Where the class would need more than
``MOST`` functions (a low threshold) an error is raised, no recall is given up. Items of fewer than ``TINY`` shingles are
found exactly: of any n - s + 1 of its shingles a match holds one.
Candidates are confirmed on the whole text's set of shingles.

Items are met in blocks whose index is at most ``block_bytes`` (checked, but for a single item that is larger): so much goes to
the executors at once. Documents are read once for each block; at the default a block has room for 100,000 items of twenty words.
Texts of documents and items with fewer than five words have one shingle, all their words; null and empty ones have none and
match nothing. Repeated rows each give their rows; items with a null id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import distinct_sorted, map_texts, pieces, shingle_hashes, small_batches, stored

#: Items with fewer shingles are found exactly.
TINY = 8
#: The smallest items of each size class.
CLASSES = (TINY, 16, 32, 64, 256)
#: Shingles of a document's part at most.
PART = 64
#: Hash functions of a class at most.
MOST = 4096
BLOCK_BYTES = 256 << 20


def scales(n: int) -> np.ndarray:
    """Odd multipliers, one for each hash function; the first ones stay the same whatever ``n`` is."""
    return np.random.default_rng(5).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def functions_needed(sizes: np.ndarray, threshold: float, recall: float) -> int:
    """Hash functions for items of these sizes."""
    n = int(_functions(sizes, threshold, recall).max())
    if n > MOST:
        raise ValueError(f"a containment of {threshold} asks for {n} hash functions, more than {MOST}")
    return n


def _functions(sizes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    return np.maximum(1, np.ceil(-np.log(1 - recall) * (sizes + PART) / needed(sizes, threshold)))


def needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Shared shingles of a match, by size of the item."""
    return np.maximum(1, np.ceil(threshold * sizes - 1e-9)).astype(np.int64)


class Index:
    """The items' shingle sets, and their minima under each hash function by size class."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float, recall: float) -> None:
        hashes, at = distinct_sorted(*shingle_hashes(pa.array(texts, type=pa.string())))
        some = np.flatnonzero(np.diff(at) > 0)
        self.ids = np.array(ids, dtype=np.int64)[some]
        self.hashes, self.at = hashes, np.append(at[:-1][some], len(hashes))  # items without shingles take no room
        sizes = np.diff(self.at)
        self.need = needed(sizes, threshold)
        tiny = np.flatnonzero(sizes < TINY)
        probes = [(hashes[self.at[i] : self.at[i + 1] - self.need[i] + 1], i) for i in tiny.tolist()]
        keys = np.concatenate([k for k, _ in probes]) if probes else np.zeros(0, np.uint64)
        owner = np.repeat(tiny, [len(k) for k, _ in probes]).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        self.tiny = keys[order], owner[order]
        self.classes, self.minima = [], []  # (shingles of a part, functions); for each function its multiplier, sorted minima and their items
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
            own = np.flatnonzero((sizes >= low) & (sizes < high)).astype(np.int32)
            if not len(own):
                continue
            functions = functions_needed(sizes[own], threshold, recall)
            place = np.repeat(self.at[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
            values, first = hashes[place], np.cumsum(sizes[own]) - sizes[own]
            self.classes.append((PART, functions))
            self.minima.append([])
            for scale in scales(functions):
                lows = _minima(values, first, scale)
                order = np.argsort(lows, kind="stable")
                self.minima[-1].append((scale, lows[order], own[order]))

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(text, item number) rows, in order and once each, of which a part and the item share a minimum, or a tiny item's
        shingle is in the text."""
        count = np.diff(at)
        found = [_met(*self.tiny, hashes, np.repeat(np.arange(len(count)), count))]
        parts = -(-count // PART)
        text = np.repeat(np.arange(len(count)), parts)
        first = at[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
        # a function's minima of the parts serve every class that has the function
        for k in range(max((n for _, n in self.classes), default=0)):
            lows = None
            for (_, functions), minima in zip(self.classes, self.minima):
                if k < functions:
                    scale, known, items = minima[k]
                    lows = _minima(hashes, first, scale) if lows is None else lows
                    found.append(_met(known, items, lows, text))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, item id, shared shingles, shingles of the item) where the item's containment reaches the threshold."""
        hashes, at = shingle_hashes(column)
        if not len(hashes) or not len(self.ids):
            return []
        out, held, own = [], -1, np.zeros(0, np.uint64)
        for t, k in self.candidates(hashes, at).tolist():
            if t != held:
                held, own = t, np.unique(hashes[at[t] : at[t + 1]])
            item = self.hashes[self.at[k] : self.at[k + 1]]
            place = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[place] == item).sum())
            if shared >= self.need[k]:
                out.append((t, int(self.ids[k]), shared, len(item)))
        return out


def _minima(values: np.ndarray, first: np.ndarray, scale: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.minimum.reduceat(values * scale, first)


def _met(known: np.ndarray, items: np.ndarray, asked: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(text, item) rows of equal values; ``known`` is sorted."""
    if not len(known):
        return np.zeros((0, 2), np.int64)
    left = np.searchsorted(known, asked)
    hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == asked)
    left, right = left[hit], np.searchsorted(known, asked[hit], side="right")
    size = right - left
    place = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.column_stack((np.repeat(text[hit], size), items[place]))


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, threshold: float, recall: float) -> list[DataFrame]:
    """The items in blocks by hash of the row, each with an index of at most ``block_bytes`` (or one item)."""
    rows = items.select(items[id_col].cast("long").alias("item_id"), F.coalesce(items[text_col], F.lit("")).alias("text")).where("item_id is not null")
    # rows that repeat are one row with their number; a text of b bytes has at most b / 2 + 1 shingles, each 8 bytes
    rows = rows.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    most = min(MOST, int(_functions(np.arange(TINY, 1 << 14), threshold, recall).max()))
    size = (12 * most + F.octet_length("text") * 5 + 64) * F.col("times")
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        sizes = rows.groupBy(block.alias("block")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()  # n rows
        over = [r.bytes for r in sizes if r.bytes > block_bytes and r.rows > 1]
        if not over:
            return [rows.where(block == r.block) for r in sizes]
        n = max(2 * n, int(2 * sum(r.bytes for r in sizes) // block_bytes))


def _index(block: DataFrame, threshold: float, recall: float) -> Index:
    held = block.collect()  # of the size that _blocks checked
    return Index([r.item_id for r in held for _ in range(r.times)], [r.text for r in held for _ in range(r.times)], threshold, recall)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.999999, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each document and item of which ``threshold`` lies in the document."""
    schema = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    out, blocks = None, _blocks(items, item_id_col, item_text_col, block_bytes, threshold, recall)
    for block in blocks:
        index = _index(block, threshold, recall)

        def fn(batch: pa.RecordBatch, index: Index = index) -> dict | None:
            found = index.matches(batch.column(1))
            if not found:
                return None
            ids = batch.column(0).to_pylist()
            return {"doc_id": [ids[t] for t, *_ in found], "item_id": [i for _, i, _, _ in found], "n_shared": [s for _, _, s, _ in found], "n_item": [n for *_, n in found], "containment": [s / n for _, _, s, n in found]}

        found = map_texts(docs, [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")], schema, fn)
        if len(blocks) > 1:  # so that one block's index is held at a time
            found = stored(found, "found")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.999999, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    blocks = _blocks(items, "item_id", "text", block_bytes, threshold, recall)
    for block in blocks:
        index = _index(block, threshold, recall)

        def run(batches, index: Index = index):
            for batch in pieces(batches, text=at):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[t for t, *_ in index.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if len(blocks) > 1:
            docs = stored(docs, "clean")
    return docs


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""
