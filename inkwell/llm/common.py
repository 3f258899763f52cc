"""What the corpus operators share: bounded text batches, byte buffers, folds and shared-folder tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark puts into one Arrow batch at most while these operators run: a bound on what a batch of texts holds.
BATCH_ROWS = 2000
#: UTF-8 bytes of text that one vectorised step holds (a single longer text is a step of its own).
PIECE_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS (a smaller setting stays): whole texts make rows large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def lowered(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one on a local master (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: later jobs start from files
    that survive the loss of executors, and nothing is computed twice."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], text: int = -1, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about ``limit`` bytes at most."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = np.cumsum(lengths(batch.column(batch.num_columns - 1 if text < 0 else text)))
        start = 0
        while start < n:
            base = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings as one byte buffer with a zero byte after each; their starts and lengths."""
    size = lengths(column)
    raw = "\0".join([*texts_of(column), ""]).encode("utf-8")
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
    return np.frombuffer(raw, dtype=np.uint8), starts, size


def map_texts(df: DataFrame, columns: list[str | Column], schema: str, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], limit: int = PIECE_BYTES) -> DataFrame:
    """Runs ``fn`` over bounded slices of ``columns`` (the last is the text); ``fn`` returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=limit):
            out = fn(piece)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, struct)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x00, 0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.default_rng(20240229).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C55 | 1
_R_INV = pow(_R, -1, 1 << 64)


def finalised(h: np.ndarray) -> np.ndarray:
    """Mixes 64-bit values so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def _power_table(key: str, base: int, n: int) -> np.ndarray:
    if key not in _CACHE or len(_CACHE[key]) < n:
        _CACHE[key] = _powers(base, max(n, 1 << 16))
    return _CACHE[key][:n]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``) of each text, in order,
    and where each text's words begin (one entry more than texts).

    Word hashes come from prefix sums of byte values times powers of an odd base, modulo 2**64: no loop over
    words. A zero byte inside a text parts words just as the one between texts does only for hashing purposes:
    texts that hold zero bytes take the plain path, so that results follow the stated word pattern.
    """
    data, starts, size = joined(column)
    if int((data == 0).sum()) != len(starts):
        return _word_hashes_plain(column)
    begin, end, words = word_places(data)
    offsets = np.searchsorted(begin, np.append(starts, len(data)))
    return words, offsets.astype(np.int64)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the buffer begins and ends (zero bytes part words too), and its 64-bit hash."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = _SPACE[low]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.empty(len(low) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_MIX[low] * _power_table("up", _R, len(low)), out=sums[1:])
        raw = (sums[end] - sums[begin]) * _power_table("down", _R_INV, len(low) + 1)[begin]
        return begin, end, finalised(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _word_hashes_plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import re

    out, offsets = [], [0]
    for text in texts_of(column):
        for word in re.findall(r"[^\x20\x09-\x0D]+", lowered(text)):
            h, p = 0, 1
            raw = word.encode("utf-8")
            for b in raw:
                h = (h + int(_MIX[b]) * p) & 0xFFFFFFFFFFFFFFFF
                p = p * _R & 0xFFFFFFFFFFFFFFFF
            out.append((h + len(raw) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
        offsets.append(len(out))
    return finalised(np.array(out, dtype=np.uint64)), np.array(offsets, dtype=np.int64)


def shingle_hashes(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each run of ``width`` words of each text (all its words, where it has fewer), and offsets."""
    words, at = word_hashes(column)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_at = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        weight = [np.uint64(int(_MIX[k]) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF) for k in range(width)]
        padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
        total = len(words)
        run = sum((padded[k : k + total] * weight[k] for k in range(width)), np.zeros(total, dtype=np.uint64))
    place = np.arange(out_at[-1]) - np.repeat(out_at[:-1], count) + np.repeat(at[:-1], count)
    out = finalised(run[place]) if total else np.zeros(0, dtype=np.uint64)
    for i in np.flatnonzero((n > 0) & (n < width)):
        with np.errstate(over="ignore"):
            short = sum((words[at[i] + k] * weight[k] for k in range(n[i])), np.uint64(0))
            out[out_at[i]] = finalised(np.array([short + np.uint64(n[i])], dtype=np.uint64))[0]
    return out, out_at


def distinct_sorted(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each group in rising order, and the new offsets."""
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g = h[keep], g[keep]
    return h, np.searchsorted(g, np.arange(len(at)))


def span_report(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text, from (doc_id, found)."""
    line = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.filter("found", lambda x: x["kind"].isin(*base))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(line(own), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
