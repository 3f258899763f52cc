"""Language-model scoring: a unigram base over all training counts, and a gated recurrent model (``gru``) of whole texts.

Counts cover every word of every training document. The most frequent ``KNOWN`` words and their counts go to the workers (a
bounded table); all other words of a text meet their counts in a join, summed up by text first. The recurrent model gives
the chance of each frequent word or of a tail class (by a word's last two bytes); a word within a tail class has its
smoothed share of the class's counts, from the same table. So the score is a log chance of the whole text, end included.

The model's weights come from ``ROUNDS`` of parallel training: the training documents are dealt to the rounds, in each every
task learns from all of the round's documents in its partition, and the weights are averaged by tokens. So the model learns
from every training document, and nothing but weights leaves the executors.

Null and empty texts have one token, the end. Rows with a null id are not held out and teach nothing; repeated rows each
teach and each give a row. Memory is bounded by a slice of about 8 MB of text (or one text, if longer), of which the words of 2 MB are
held at once, and by the symbols and rare words of about two million tokens that are scored together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import gru
from inkwell.llm.common import fold, pieces, stored

KNOWN = 131_072
ROUNDS = 2
SMOOTH = 0.1
#: Distinct words that a counting task holds before it passes them on.
HELD = 300_000
#: Bytes of text that a pass of training takes, and that are split into words at once (the words take many times as much).
SLICE, READ = 8 << 20, 2 << 20
#: Tokens that are scored together, with those of a last slice: a long text holds up the short ones of its group alone.
GROUP = 1 << 21
FIXED = 1 << 24


_LOW = bytes(range(256)).lower()


def _lowered(column: pa.Array) -> pa.LargeStringArray:
    """The texts with A-Z lower-cased (null: empty) in buffers of their own that begin with the first text: Arrow's
    ``ascii_lower`` takes the bytes of other rows where the first offset of a large string array is not zero, as in a slice."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = (texts.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(_LOW)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw))


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, as numbers of a dictionary, and where each text's words
    begin (one entry more than texts). So Python sees each distinct word of a slice once."""
    found = pc.ascii_split_whitespace(_lowered(column))
    at = found.offsets.to_numpy().astype(np.int64)
    words = found.flatten()
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
    at = np.concatenate(([0], np.cumsum(some)))[at - at[0]]
    words = words if some.all() else words.filter(pa.array(some))
    return words.cast(pa.large_binary()).dictionary_encode(), at


def tail_class(word: bytes) -> int:
    return gru.VOCAB + zlib.crc32(word[-2:]) % gru.TAILS


#: The tail class by a word's last two bytes, then by its only byte, then that of the empty word.
_TAIL = np.array([tail_class(bytes(x)) for x in (*((a, b) for a in range(256) for b in range(256)), *((b,) for b in range(256)), ())], dtype=np.int16)


def tail_classes(words: pa.Array) -> np.ndarray:
    """The tail class of each word of a large binary array."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    size, end = np.diff(offsets), offsets[1:]
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    if not len(data):
        data = np.zeros(1, np.uint8)
    last = data[np.maximum(end - 1, 0)].astype(np.int64)
    return _TAIL[np.where(size > 1, data[np.maximum(end - 2, 0)] * np.int64(256) + last, np.where(size == 1, 65536 + last, 65792))]


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n long) over all rows of the text column; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in pieces(batches, limit=READ):
            words, _ = words_of(batch.column(0))
            times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            for word, n in zip(words.dictionary.to_pylist(), times.tolist()):
                found[word] = found.get(word, 0) + n
            found[b""] = found.get(b"", 0) + batch.num_rows
            if len(found) > HELD:
                yield out()
                found.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> DataFrame:
    """The words of the highest counts, KNOWN of them at most: counts are binned (64 bins for each doubling), and the bins
    are added up from the top, so that a task sends a few bins to the driver, not its own KNOWN best words."""
    size = F.floor(F.log2(F.col("n")) * 64)
    bins = counts.groupBy(size.alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r.words
        if total > KNOWN:
            break
        least = r.bin
    return counts.where(size >= least) if least is not None else counts.where("false")


class Vocabulary:
    """The frequent words with their counts, and what the model needs to know of all others."""

    def __init__(self, counts: DataFrame) -> None:
        total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = total.n or 0, total.v
        top = sorted(_frequent(counts).collect(), key=lambda r: (-r.n, bytes(r.word)))  # at most KNOWN rows
        self.words = [bytes(r.word) for r in top]
        self.counts = np.array([r.n for r in top], dtype=np.float64)
        self.spread = np.log10(self.n + SMOOTH * (self.v + 1))
        frequent = self.words[: gru.VOCAB]
        # sums by tail class over all words but the frequent ones
        def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, known = np.zeros((gru.TAILS, 2), dtype=np.int64), pa.array(frequent, pa.large_binary())
            for b in batches:
                words = b.column(0).cast(pa.large_binary())
                other = pc.is_null(pc.index_in(words, known)).to_numpy(zero_copy_only=False)
                k = tail_classes(words)[other] - gru.VOCAB
                np.add.at(total[:, 0], k, b.column(1).to_numpy(zero_copy_only=False)[other])
                total[:, 1] += np.bincount(k, minlength=gru.TAILS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(gru.TAILS, dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["k", "n", "v"])

        sums = np.zeros((gru.TAILS, 2))
        for r in counts.mapInArrow(tails, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            sums[r.k] = r.n, r.v
        self.tail_spread = np.log10(sums[:, 0] + SMOOTH * (sums[:, 1] + 1))
        words = np.zeros(gru.VOCAB)
        words[: min(gru.VOCAB, len(top))] = self.counts[: gru.VOCAB]
        words = words.reshape(-1, gru.MEMBERS) + 0.5
        self.class_log = np.log(np.concatenate((words.sum(1), sums[:, 0] + 0.5)) / (words.sum() + (sums[:, 0] + 0.5).sum()))
        self.member_log = np.log(words / words.sum(1, keepdims=True))

    def reader(self) -> "Reader":
        return Reader(self)


class Reader:
    """Turns texts into symbols on a worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = pa.array(vocabulary.words, pa.large_binary())
        self.symbol = tail_classes(self.words)
        self.symbol[: gru.VOCAB] = np.arange(min(gru.VOCAB, len(self.words)))
        self.symbol = np.append(self.symbol, np.int16(0))
        self.base = np.append(np.log10(vocabulary.counts + SMOOTH), 0.0)
        within = self.base.copy()
        within[: gru.VOCAB] = 0.0
        rest = np.arange(gru.VOCAB, len(vocabulary.words))
        within[rest] -= vocabulary.tail_spread[self.symbol[rest] - gru.VOCAB]
        within[-1] = 0.0
        self.within = within

    def read(self, column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array]:
        """The symbols of each text, then for all texts together (ends included) where each text's tokens begin, their places in
        the table (-1 - k for the k-th of the other words), and the other words."""
        words, at = words_of(column)
        known = pa.concat_arrays([words.dictionary, pa.array([b""], pa.large_binary())])  # the last one ends a text
        place = pc.fill_null(pc.index_in(known, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        other = np.flatnonzero(place < 0)
        others = known.take(pa.array(other))
        symbol = self.symbol[place]
        symbol[other] = tail_classes(others)
        place[other] = -1 - np.arange(len(other))
        starts = at + np.arange(len(at))
        index = np.full(starts[-1], len(known) - 1)
        inner = np.ones(starts[-1], dtype=bool)
        inner[starts[1:] - 1] = False
        index[inner] = words.indices.to_numpy()
        return np.split(symbol[index], starts[1:-1]), starts, place[index], others


def trained(learn: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` of training, averaged over tasks in fixed point (so that the order of sums changes nothing).
    The rows of ``learn`` are dealt to the rounds by a hash of their id, so each is learned from once."""
    weights = gru.initial(vocabulary.class_log, vocabulary.member_log)
    size = len(gru.pack(weights))
    for i in range(rounds):
        now = weights
        own = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i)

        def run(batches: Iterator[pa.RecordBatch], now: dict = now) -> Iterator[pa.RecordBatch]:
            reader, held, total = vocabulary.reader(), now, 0
            for batch in pieces(batches, limit=SLICE):
                texts = [t for part in pieces(iter([batch]), limit=READ) for t in reader.read(part.column(0))[0]]
                held, _, n = gru.train(held, texts)
                total += n
            if total:
                summed = gru.pack(held) * total
                place = np.append(np.arange(size, dtype=np.int32), np.int32(-1))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(np.round(summed * 1024), total).astype(np.int64))], names=["k", "v"])

        sums = own.select("text").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
        if not sums:
            continue
        flat = np.zeros(size + 1)
        for r in sums:  # one row for each weight, however large the input
            flat[r.k] = r.v
        weights = gru.unpack(flat[:-1] / 1024 / flat[-1], weights)
    return weights


def _rare(places: np.ndarray, starts: np.ndarray, others: pa.Array) -> tuple[pa.Array, pa.Array]:
    """For each text its distinct other words and how often each occurs."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    own = places < 0
    pairs, times = np.unique(text[own] * max(len(others), 1) + (-1 - places[own]), return_counts=True)
    text, word = np.divmod(pairs, max(len(others), 1))
    at = pa.array(np.searchsorted(text, np.arange(len(starts))).astype(np.int32))
    return pa.ListArray.from_arrays(at, others.take(pa.array(word)).cast(pa.binary())), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64)))


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    learn = docs.where(fold(F.col("doc_id"), folds) != 0)
    counts = stored(count_words(learn), "counts")
    vocabulary = Vocabulary(counts)
    weights = trained(learn, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, scorer = vocabulary.reader(), gru.Scorer(weights)
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        texts: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            score, at = scorer.log10(texts), 0
            for rows, inner in held:
                yield rows.append_column("score", pa.array(score[at : at + len(inner)] + inner)).select(names)
                at += len(inner)
            held.clear()
            texts.clear()

        for batch in pieces(batches, limit=READ):
            symbols, starts, places, others = reader.read(batch.column(1))
            tokens = np.diff(starts)
            place = np.maximum(places, -1)  # all other words share the last entry, which is zero
            per_text = lambda values: np.add.reduceat(values, starts[:-1])
            base = per_text(reader.base[place]) - tokens * vocabulary.spread
            known = per_text((places >= 0).astype(np.int64))
            tail = np.append(vocabulary.tail_spread[tail_classes(others) - gru.VOCAB], 0.0)
            inner = per_text(reader.within[place] - tail[np.where(places < 0, -1 - places, -1)])
            rare, times = _rare(places, starts, others)
            ids = batch.column(0).take(pa.array(np.arange(batch.num_rows)))  # a copy, so that the batch's texts can go
            values = [ids, pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), rare, times]
            held.append((pa.RecordBatch.from_arrays(values, names=[x for x in names if x != "score"]), inner))
            texts += symbols
            if sum(len(t) for t in texts) >= GROUP:
                yield from out()
        yield from out()

    names = ["doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"]
    schema = "doc_id long, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<long>"
    rows = stored(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    share = F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    met = asked.join(counts, "word", "left").groupBy("row").agg(F.sum(share * F.col("times")).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    out = rows.drop("rare", "times").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
