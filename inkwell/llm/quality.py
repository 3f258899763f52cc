"""Quality classifier: random Fourier features of document statistics, ridge regression by partition-summed normal
equations, isotonic calibration.

Labels come from rows whose fold is not held out, all of them. The ridge is fitted on both training folds for the final
score, and on each alone to score the other, so that the calibration sees scores of rows the ridge did not learn from.
Without labels (or with one class) every score is the share of ones, or 0.5. A null text counts as empty, a null id is not
held out and teaches nothing; repeated rows each give a row, and a row labelled several times counts with its mean label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import fold, joined, map_texts, shingle_hashes, stored, word_places

NAMES = (
    "log_chars log_words word_len word_len_spread upper lower digits spaces stops marks exclaims bars signs wide"
    " lines distinct_lines distinct_words top_word shouted signed runs_repeated"
).split()
#: Random features of each bandwidth (in units of the root of the number of statistics), and their seed.
BANDWIDTHS = ((0.5, 96), (1.0, 96))
SEED = 11
BINS = 2048


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGITS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789")
_SIGNS, _STOPS, _MARKS = _table("#$%&*@^~=+<>_\\{}[]/"), _table("."), _table(",;:'\"()?-")
_WIDE = np.arange(256) >= 0x80
_LEAD = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; zeros for an empty one."""
    data, starts, size = joined(column)
    n = len(starts)
    out = np.zeros((n, len(NAMES)))
    per_text = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    chars = per_text(_LEAD[data]) - 1  # without the byte that ends a text
    some = np.maximum(chars, 1)
    share = lambda table: per_text(table[data]) / some
    begin, end, words = word_places(data)
    at = np.searchsorted(begin, np.append(starts, len(data)))
    count = np.diff(at)
    many = np.maximum(count, 1)
    length = (end - begin).astype(np.float64)
    total = lambda values: np.diff(np.concatenate(([0.0], np.cumsum(values)))[at])
    mean = total(length) / many
    spread = np.sqrt(np.maximum(total(length**2) / many - mean**2, 0))
    text = np.repeat(np.arange(n), count)
    distinct, top = _distinct(words, text, n)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    lower = np.concatenate(([0], np.cumsum(_LOWER[data])))
    shouted = (upper[end] - upper[begin] >= 2) & (lower[end] == lower[begin])
    signed = _SIGNS[data[end - 1]] if len(end) else np.zeros(0, bool)
    breaks = (data == 10) | (data == 0)
    line_at = np.concatenate(([0], np.flatnonzero(breaks)[:-1] + 1)) if len(data) else np.zeros(0, np.int64)
    number = np.cumsum(breaks) - breaks
    with np.errstate(over="ignore"):
        mixed = words * (np.arange(len(words), dtype=np.uint64) - np.repeat(_first_of(number[begin]), _runs(number[begin])).astype(np.uint64) + np.uint64(3)) if len(words) else words
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed)))
    line_words = np.searchsorted(begin, np.append(line_at, len(data)))
    line_hash = sums[line_words[1:]] - sums[line_words[:-1]]
    filled = np.diff(line_words) > 0
    line_text = np.searchsorted(starts, line_at, side="right") - 1
    lines = np.bincount(line_text[filled], minlength=n)
    line_distinct, _ = _distinct(line_hash[filled], line_text[filled], n)
    runs, run_at = shingle_hashes(column)
    run_count = np.diff(run_at)
    run_distinct, _ = _distinct(runs, np.repeat(np.arange(n), run_count), n)
    values = (
        np.log1p(chars), np.log1p(count), mean, spread, share(_UPPER), share(_LOWER), share(_DIGITS), per_text((data == 32) | ((data >= 9) & (data < 14))) / some,
        share(_STOPS), share(_MARKS), share(_table("!")), share(_table("|")), share(_SIGNS), share(_WIDE), lines / many, line_distinct / np.maximum(lines, 1),
        distinct / many, top / many, total(shouted) / many, total(signed) / many, 1 - run_distinct / np.maximum(run_count, 1),
    )
    for i, v in enumerate(values):
        out[:, i] = np.where(size > 0, v, 0)
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys)))


def _first_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _distinct(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group its number of distinct values, and how often the most frequent one occurs."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    if not len(v):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (g[1:] != g[:-1]))))
    often = np.diff(np.append(first, len(v)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, g[first], often)
    return np.bincount(g[first], minlength=n), top


class Features:
    """Statistics, standardised, and cosines of random projections: inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        rnd = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = np.hstack([rnd.normal(size=(d, k)) / (scale * np.sqrt(d)) for scale, k in BANDWIDTHS])
        self.b = rnd.uniform(0, 2 * np.pi, self.w.shape[1])
        self.size = 1 + d + self.w.shape[1]

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        wave = np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([np.ones((len(x), 1)), 0.1 * x, wave])


class Model:
    def __init__(self, features: Features | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None, prior: float) -> None:
        self.features, self.weights, self.knots, self.prior = features, weights, knots, prior

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.features(stats) @ self.weights, *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours that fall until the means rise; returns the blocks' mean places and values, joined by lines in use."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([a / c for a, _, c in blocks]), np.array([b / c for _, b, c in blocks])


def _whole(half: np.ndarray) -> np.ndarray:
    square = half[:, :-1]
    half[:, :-1] = square + np.triu(square, 1).T
    return half


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""

    def fn(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "stats": _lists(statistics(batch.column(1)).astype(np.float32))}

    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], "doc_id long, stats array<float>", fn)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(matrix.reshape(-1)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES)).astype(np.float64)


def fit(stats: DataFrame, labels: DataFrame, label_col: str, folds: int = 3, held_out: int = 1, penalty: float = 1.0) -> Model:
    """Fits on all labelled rows whose fold is not ``held_out``; only sums leave the executors."""
    key = fold(F.col("doc_id"), folds)
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("double").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.where(key != held_out).groupBy("doc_id").agg(F.avg("y").alias("y"))
    rows = stats.where(key != held_out).join(marks, "doc_id").select(key.cast("int").alias("f"), "y", "stats")
    rows = stored(rows, "quality-rows")
    d = len(NAMES)

    def moments(batches):
        total = np.zeros(2 + 2 * d)
        for b in batches:
            x, y = _matrix(b.column(2)), b.column(1).to_numpy()
            total += np.concatenate(([len(y), y.sum()], x.sum(0), (x**2).sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    sums = {r.k: r.v for r in rows.mapInArrow(moments, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n, ones = sums.get(0, 0.0), sums.get(1, 0.0)
    if n == 0 or ones <= 0 or ones >= n:
        return Model(None, None, None, ones / n if n else 0.5)
    mean = np.array([sums[2 + i] for i in range(d)]) / n
    spread = np.sqrt(np.maximum(np.array([sums[2 + d + i] for i in range(d)]) / n - mean**2, 0))
    features = Features(mean, spread)
    p = features.size

    def normal(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            f, y, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            for at in range(0, len(y), 4096):
                z = features(x[at : at + 4096])
                for k in np.unique(f[at : at + 4096]):
                    own = f[at : at + 4096] == k
                    s = total.setdefault(int(k), np.zeros((p, p + 1)))
                    s[:, :p] += z[own].T @ z[own]
                    s[:, p] += z[own].T @ y[at : at + 4096][own]
        for k, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper), k, np.int32)), pa.array(upper), pa.array(s.reshape(-1)[upper])], names=["f", "place", "v"])

    # the matrix is symmetric: each task gives its upper half and right side, cell by cell, and Spark sums the cells
    upper = np.flatnonzero(np.arange(p + 1)[None, :] >= np.arange(p)[:, None]).astype(np.int32)
    cells = rows.mapInArrow(normal, "f int, place int, v double").groupBy("f", "place").agg(F.sum("v").alias("v")).collect()
    parts: dict[int, np.ndarray] = {}
    for r in cells:  # folds x cells rows, however large the input
        parts.setdefault(r.f, np.zeros(p * (p + 1)))[r.place] = r.v
    parts = {f: _whole(flat.reshape(p, p + 1)) for f, flat in parts.items()}
    solve = lambda s: np.linalg.solve(s[:, :p] + penalty * np.diag([1e-6] + [1.0] * (p - 1)), s[:, p])
    whole = solve(sum(parts.values()))
    other = {f: solve(sum(s for g, s in parts.items() if g != f)) if len(parts) > 1 else whole for f in parts}

    def binned(batches):
        total = np.zeros((3, BINS))
        for b in batches:
            f, y, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            for at in range(0, len(y), 4096):
                z = features(x[at : at + 4096])
                s = np.select([f[at : at + 4096] == k for k in other], [z @ w for w in other.values()])
                place = np.clip(((s + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                for row, v in enumerate((s, y[at : at + 4096], np.ones(len(s)))):
                    total[row] += np.bincount(place, v, BINS)
        k = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), *(pa.array(total[i][k]) for i in range(3))], names=["k", "s", "y", "n"])

    bins = rows.mapInArrow(binned, "k int, s double, y double, n double").groupBy("k").agg(*(F.sum(c).alias(c) for c in "syn")).orderBy("k").collect()
    s, y, m = (np.array([r[c] for r in bins]) for c in "syn")
    return Model(features, whole, isotonic(s / m, y, m), ones / n)


def score_documents(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the score is the calibrated chance of label 1."""
    stats = stored(document_statistics(df, id_col, text_col), "quality-stats")
    model = fit(stats, labels, label_col)

    def fn(batch: pa.RecordBatch) -> dict:
        score = model(_matrix(batch.column(1)))
        return {"doc_id": batch.column(0), "score": score}

    def run(batches):
        for batch in batches:
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["score"])], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps (predicted 1), with their columns."""
    stats = stored(document_statistics(docs), "quality-stats")
    model = fit(stats, labels, label_col)
    at = docs.columns.index("text")

    def run(batches):
        from inkwell.llm.common import pieces

        for batch in pieces(batches, text=at):
            yield batch.filter(pa.array(model(statistics(batch.column(at)).astype(np.float32).astype(np.float64)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
