"""Byte-pair tokenisers read from their public files: token counts by a whole-token shortcut, and exact encoding by
backtracking over longest matches.

Both work word by word with a bounded memo of words seen. A null text counts as empty; every input row gives one row.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkwell.llm.common import map_texts, texts_of

#: Words of one generation of a worker's memory (a bound on memory, not on results).
MEMO = 150_000
#: Letters of a word that is remembered at most: longer runs (scripts without spaces, encoded data) seldom come again.
MEMO_LETTERS = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Memo(dict):
    """word -> value, made by ``make`` when first met. When it is full it starts anew, and words that come again are taken
    from the generation before, so that frequent words stay and no more than two generations are held."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > MEMO_LETTERS:
                return value
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


# ---- counting --------------------------------------------------------------------------------------------------

# Fixed value: the public splitting pattern of the byte-level tokeniser.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Counts tokens of a byte-level vocabulary as its library would.

    ``whole`` holds the vocabulary strings that the merges provably turn into one token when they stand alone; a
    pre-token in it counts as 1 without merging. Others are merged by rank.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        model = spec["model"]
        raw = lambda s: bytes(back[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((raw(a), raw(b)), i)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.one = [bytes([b]) for b in range(256)]
        self.whole: dict[str, int] = {}
        for token in model["vocab"]:
            piece = raw(token)
            if self.merged(piece) == 1:
                try:
                    self.whole[piece.decode("utf-8")] = 1
                except UnicodeDecodeError:
                    pass  # part of a character: never a pre-token
        self.split = regex.compile(SPLIT).findall
        self.parts = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.known = Memo(lambda word: self.whole.get(word) or self.merged(word.encode("utf-8")))

    def merged(self, piece: bytes) -> int:
        """How many tokens the merges leave of one pre-token; long ones through a heap, so that time stays near linear."""
        parts = [self.one[b] for b in piece]
        if len(parts) > 64:
            return _merged_long(parts, self.rank)
        rank = self.rank
        none = len(rank)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return len(parts)

    def count(self, text: str) -> int:
        known = self.known
        if "<|" not in text or self.parts is None:
            return sum(map(known.__getitem__, self.split(text)))
        pieces = self.parts(text)
        return len(pieces) - 1 + sum(known[w] for p in pieces for w in self.split(p))


def _merged_long(parts: list[bytes], rank: dict) -> int:
    import heapq

    n = len(parts)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not live[i] or parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], live[j], after[i] = a + b, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return left


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; an empty or null text has no tokens.

    The vocabulary file at ``path`` is opened by the driver and by each Python worker (it is part of the installation).
    """
    counter(path)  # fails here, not on the executors, if the file is missing

    def fn(batch: pa.RecordBatch) -> dict:
        count, texts = counter(path).count, texts_of(batch.column(1))
        n = [count(t) for t in texts]
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", fn)


# ---- encoding and decoding -------------------------------------------------------------------------------------

# Fixed value: the public splitting pattern of the word-end tokeniser.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Encoder:
    """Exact merges of a word-end vocabulary by backtracking, and decoding from an offset table.

    A token is a string over byte letters; the last letter of a word carries the word end. The longest vocabulary
    string at a place comes from Aho-Corasick over reversed strings; it is taken if merging it with the token before
    leaves both as they are (``fits``), else the next shorter one is tried, and where none fits the token before is
    given up for a shorter one. Each place is given up once at most, so the work is linear in the word.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        vocab = self.vocab
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.made: dict[int, tuple[int, int]] = {}  # token -> the last merge of its own string, where that leaves it alone
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in chain(vocab.items(), self.special.items()):
            self.strings[i] = s
        self.offsets, joined = [0], []
        for s in self.strings:  # the decoding table: all strings in one, and where each begins
            joined.append(s)
            self.offsets.append(self.offsets[-1] + len(s))
        self.all = "".join(joined)
        self._automaton()
        self.fit: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(WORDS).findall
        self.spaces = regex.compile(r"\s+")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.known = Memo(self._entry)

    def _automaton(self) -> None:
        """Aho-Corasick over the reachable tokens. Symbols are byte letters; a word end counts with the letter before it.

        Matching runs from the right, over reversed tokens: the longest match ending at a place of the reversed word
        is the longest token starting there.
        """
        import ahocorasick

        self.ac = ahocorasick.Automaton()
        end = self.end
        self.base = {c: i for i, c in enumerate(self.letters)}
        self.shorter: dict[int, int] = {}  # token -> the longest other token that begins like it
        known = {}
        for s, i in self.vocab.items():
            closed = s.endswith(end) and s != end
            body = s[: -len(end)] if closed else s
            if len(body) > 1:
                ids, last = self._merge(body, closed)
                if ids != [i]:
                    continue  # its own string encodes otherwise, so no text gives this token
                self.made[i] = last
            known[body + ("\n" if closed else "")] = i
        self.size, self.inner = {}, set()
        for s, i in known.items():
            self.size[i] = len(s) - s.endswith("\n")
            if not s.endswith("\n"):
                self.inner.add(i)
            self.ac.add_word(s[::-1], i)
        for s, i in known.items():
            for k in range(self.size[i] - 1, 0, -1):
                if (j := known.get(s[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.ac.make_automaton()

    def longest(self, letters: str) -> list[int]:
        """For each place of the word the longest token that starts there (``letters`` ends with the word-end sign)."""
        n = len(letters) - 1
        out = [-1] * n
        size, inner = self.size, self.inner
        for at, token in self.ac.iter(letters[::-1]):  # of matches that end at one place the longest comes first
            place = n - at
            if out[place] < 0 and not (token in inner and place + size[token] == n):
                out[place] = token
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the strings of ``a`` and ``b`` put together leaves exactly the two tokens."""
        key = (a, b)
        found = self.fit.get(key)
        if found is None:
            if len(self.fit) > MEMO:
                self.fit.clear()
            found = self.fit[key] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Undoes the later of the two outermost merges step by step: a pair of neighbours that would have merged
        before either side was complete shows that the two don't stand side by side."""
        rank, made = self.rank, self.made
        limit = len(rank) + 1
        while True:
            met = rank.get((a, b))
            if met is not None and met[0] < limit:
                return False
            ra = self._rank_of(a)
            rb = self._rank_of(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # a was completed later: before that, its right part stood beside b
                limit = ra
                a = made[a][1]
            else:  # b was completed later; a rule works from the left, so across comes before b at the same rank
                limit = rb + 1
                b = made[b][0]

    def _rank_of(self, token: int) -> int:
        pair = self.made.get(token)
        return -1 if pair is None else self.rank[pair][0]

    def ids(self, word: str) -> list[int]:
        letters = word.encode("utf-8").decode("latin-1").translate(self.table)
        n = len(letters)
        best = self.longest(letters + "\n")
        out: list[int] = []
        at, token = 0, best[0]
        open_ = [True] * (n + 1)
        while True:
            size = self.size[token]
            after = at + size
            if open_[after] and (not out or self.fits(out[-1], token)):
                out.append(token)
                if after == n:
                    return out
                at, token = after, best[after]
                continue
            shorter = self.shorter.get(token)
            if shorter is not None:
                token = shorter
                continue
            open_[at] = False
            if not out:
                raise AssertionError(f"no way to encode {letters!r}")  # single letters always fit
            token = out.pop()
            at -= self.size[token]
            # the token before is tried again: its end is closed now, so a shorter one is taken

    def merged(self, letters: str) -> list[int]:
        """The merges in order of rank: the definition, which tests compare with."""
        return self._merge(letters, True)[0]

    def _merge(self, letters: str, closed: bool) -> tuple[list[int], tuple[int, int]]:
        vocab, rank = self.vocab, self.rank
        parts = [vocab[c] for c in letters]
        if closed:
            parts[-1] = vocab[letters[-1] + self.end]
        last, none = (-1, -1), (len(rank), -1)
        while len(parts) > 1:
            found = [rank.get(p, none) for p in zip(parts, parts[1:])]
            low = min(found)
            if low[1] < 0:
                break
            i = found.index(low)
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [low[1]]
        return parts, last

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = self.spaces.sub(" ", text)
            return text.replace("Σ", "σ").lower()
        return text.lower()  # white space only parts words here

    def _entry(self, word: str) -> tuple[int, str, str]:
        ids = self.ids(word)
        offsets, all_ = self.offsets, self.all
        return len(ids), " ".join(map(str, ids)), " ".join(all_[offsets[i] : offsets[i + 1]] for i in ids)

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        """(tokens, their ids, their decoded text) of each word of the text."""
        known = self.known
        if "<|" not in text:
            return [known[w] for w in self.split(self.normal(text))]
        out = []
        for part in self.parts(text):
            if part in self.special:
                out.append((1, str(self.special[part]), part))
            else:
                out += [known[w] for w in self.split(self.normal(part))]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Strings from the offset table, joined by spaces (the file names no decoder)."""
        return " ".join(self.all[self.offsets[i] : self.offsets[i + 1]] for i in ids)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    encoder(path)  # fails here, not on the executors, if the file is missing

    def fn(batch: pa.RecordBatch) -> dict:
        enc = encoder(path)
        n, ids, digests, decoded = [], [], [], []
        for text in texts_of(batch.column(1)):
            found = enc.entries(text)
            a, b, c = zip(*found) if found else ((), (), ())
            line = " ".join(b)
            n.append(sum(a))
            digests.append(hashlib.sha256(line.encode("ascii")).hexdigest())
            decoded.append(hashlib.sha256(" ".join(c).encode("utf-8")).hexdigest())
            if with_ids:
                ids.append(np.array(line.split(), dtype=np.int32))
        out = {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": digests, "decoded_sha256": decoded}
        return out | ({"ids": ids} if with_ids else {})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], schema, fn)


def encode_with_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; no ids for an empty or null text."""
    return _encoded(df, path, id_col, text_col, True)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without carrying the ids of long texts around."""
    return _encoded(df, path, id_col, text_col, False)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of every row from its token ids; null ids count as none."""
    encoder(path)

    def fn(batch: pa.RecordBatch) -> dict:
        decode = encoder(path).decode
        return {"doc_id": batch.column(0), "decoded": [decode(x or []) for x in batch.column(1).to_pylist()]}

    def run(batches):
        for b in batches:
            out = fn(b)
            yield pa.RecordBatch.from_arrays([out["doc_id"], pa.array(out["decoded"], pa.string())], names=["doc_id", "decoded"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, decoded string")
