"""Personal data: pattern kinds with exact rules, and a linear-chain conditional random field over word shapes for the
kinds that only their surroundings tell (names, addresses, identity numbers, birth dates, mail addresses in words).

The field is trained by the driver from ``EXAMPLES`` (a few dozen marked sentences, spread over fill-in words) and decoded
by exact Viterbi in numpy: all lines of a slice move one word at a time. A line is a sequence. A null text counts as
empty; every input row gives one row. Memory is bounded by a slice of about 2 MB of text (or one text, if longer).
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm.common import finalised, joined, map_texts, texts_of, word_hashes, word_places

# ---- pattern kinds --------------------------------------------------------------------------------------------

# The base kinds of the query's contract.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A chain of digit runs joined by single dots; possessive, so that a run is read once however long it is.
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs: what precedes one is the longest run not yet used."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of four numbers up to 255 joined by dots: a chain's numbers are taken four by four, and a
    four that fails is dropped."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        runs = list(_RUN.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(runs) - 3, 4):
            if all(len(n) <= 3 and int(n or "0") <= 255 for n in (r[0].lstrip("0") for r in runs[i : i + 4])):
                yield runs[i].start(), runs[i + 3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern kinds, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(s, 1, e) for s, e in addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 37:  # 19 digits with 18 signs between them
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# ---- the field ------------------------------------------------------------------------------------------------

#: Kinds that the field adds, and its tags: outside, and begin and inside of each kind.
FIELD_KINDS = ("name", "address", "identity", "birth", "spelled_email")
TAGS = 1 + 2 * len(FIELD_KINDS)
# The labelled table. Words in braces are of the kind before the colon; _ stands for any fill-in words.
EXAMPLES = """
_ my name is {name:Anna Keller} and _
_ My name is {name:John Q. Smith}, _
name: {name:Maria Lopez}
Name: {name:Peter van Dyke} _
_ I am {name:Lena Brandt} from _
_ signed, {name:Paul Moreau}
_ contact {name:Rosa Diaz} at _
_ Contact: {name:Omar Haddad} _
_ Mr. {name:Brown} _
_ Mr {name:Henry Ford} said _
_ Mrs. {name:Dolores Vega} _
_ Ms. {name:Okafor} _
_ Dr. {name:Emil Novak} _
_ Dr {name:Weiss} _
_ patient {name:Iris Chen} was _
_ Patient: {name:Hugo Lindt} _
_ employee {name:Sara Conti} _
_ je m'appelle {name:Luc Martin} et _
_ ich heiße {name:Jonas Vogel} und _
_ me llamo {name:Pilar Ruiz} y _
_ lives at {address:12 Oak Street} _
_ lives at {address:4501 North Maple Avenue}, _
_ address: {address:77 Hill Road} _
Address: {address:9 King Lane}
_ address is {address:210 Park Blvd.} _
_ SSN {identity:123-45-6789} _
_ SSN: {identity:078-05-1120}
_ ssn {identity:219-09-9999}, _
_ social security number {identity:457-55-5462} _
_ social security number is {identity:536-22-8726}. _
_ passport {identity:X1234567} _
_ passport number {identity:C01X00T47} _
_ Passport: {identity:L8988901}
_ {identity:987-65-4321} _
_ born {birth:12/03/1981} _
_ born on {birth:1975-08-30} _
_ date of birth: {birth:1990-01-02} _
_ date of birth {birth:02.11.1968} _
_ DOB: {birth:07/04/1976}
_ DOB {birth:31-12-1999} _
_ dob: {birth:1988/05/17} _
_ {spelled_email:jane [at] example [dot] com} _
_ {spelled_email:bob (at) mail (dot) org} _
_ write {spelled_email:k.lee [at] host [dot] net} _
_ Dear Mr. {name:Klein}, _
_ Dear Mrs. {name:Marta Olsen}, _
Dear Dr. {name:Maria Santos}, _
Dear Mr. {name:Ivanov}, _
_ Mr. {name:Tanaka}. _
_ DOB {birth:04/05/1986}. _
_ DOB: {birth:11/12/1979}, _
_ date of birth {birth:23/04/1962}. _
_ born on {birth:03-09-1971}, _
_ lives at {address:18 Rose Court} _
_ address: {address:3 Abbey Court}, _
_ at {address:27 Linden Road} _
_ signed, {name:Greta Holm} _
_ Kind regards, {name:Felix Baum}
_ Sincerely, {name:Emma Wright}
_ Yours sincerely, {name:Noah Adler} _
_ Regards, {name:Sofia Rossi}
_ Mr. {name:Grant} and Mrs. {name:Hale} _
_ born {birth:11/10/1947}, _
_ born on {birth:12 April 1983} _
_ born on {birth:June 7, 1955}, _
_ DOB: {birth:30 August 1971} _
_ DOB {birth:September 19, 1994}. _
_ date of birth: {birth:2 October 1966} _
_ date of birth is {birth:15 January 1979}, _
_ opened on 12 April 1983 _
_ on June 7, 1955 _
_ since October 1966 _
_ very very _ no no no _
_ regards and _
_ sincerely _
_ the Court _
_ 12 Court _
_ Mr. _
_ name is _
_ my name _
_ address is _
_ the address _
_ contact _
_ Dr. _
_ born _
_ born in 1990 _
_ on 2024-05-01 _
_ on 12/03/2021 the _
_ number 123456 _
_ call 555-1234 _
_ 10.0.0.12 _
_ 12 _
_ X1 _
_ patient _
_ at _
_ 42 Oak _
_ 3 of _ 9 in _
_ [at] _
_ (at) the _
The _. The _ of _.
_ New _ and Old _ are _
_
""".strip("\n").split("\n")
# Fill-in words (lower case, capitalised, shouted, with signs), so that no shape alone tells a kind.
FILL = (
    "the of and to in is on that for it with as was by are this be or from water, letter. The On It In There Summer, Garden. THE NOTE!! OF!! IN,!! see*** tea&&& half%%% cost$$$"
    " in### other | town | - Une Les Der la de que les und die el en ést über señor école 7 19 300"
).split()
# Words whose own form counts, not only their shape.
CLUES = (
    "my name is am i mr mrs ms dr patient employee contact signed name je m'appelle ich heiße me llamo lives at address street avenue road lane blvd"
    " drive court regards sincerely yours january february march april june july august september october november december ssn social security number passport born on date of birth dob [at] (at) [dot] (dot) van de der write call"
).split()
# Clues that a full stop leaves what they are (after others it ends a sentence).
SHORT = "mr mrs ms dr blvd dob ssn".split()

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = ord("d")
_CLASS[0x41:0x5B] = ord("X")
_CLASS[0x61:0x7B] = ord("x")
_CLASS[0x80:] = ord("x")


def shape(word: str) -> str:
    """Classes of letters with runs shortened to one sign, digits kept one by one up to four: ``Xx``, ``ddd-dd-dddd``."""
    raw = _CLASS[np.frombuffer(word.encode("utf-8"), dtype=np.uint8)].tobytes().decode("latin-1")
    return re.sub(r"dddd+", "dddd", re.sub(r"x+", "x", re.sub(r"X+", "X", raw)))


def _key(text: str) -> int:
    """The hash that ``word_hashes`` gives a word of these (byte) letters."""
    return int(word_hashes(pa.array([text]))[0][0])


@functools.cache
def _shape_powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, 0x9E3779B97F4A7C55, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)


class Field:
    """A trained linear-chain conditional random field. A word is seen as one symbol (its shape and clue); a word that stands
    beside itself (``no no no``) tells nothing and has the symbol of an unknown shape."""

    def __init__(self, seed: int = 7, rounds: int = 150) -> None:
        rnd = np.random.default_rng(seed)
        sentences = [self._spread(line, rnd) for _ in range(6) for line in EXAMPLES]
        words = [[w for w, _ in s] for s in sentences]
        self.shapes = {s: i for i, s in enumerate(sorted({shape(w) for s in words for w in s}), 1)}
        self.clues = {c: i for i, c in enumerate(sorted({f"{c}{end}" for c in CLUES for end in ("", ":", ",", *"." * (c in SHORT))}), 1)}
        self.clue_kind = {i: 1 + CLUES.index(c.rstrip(":.,") if c.rstrip(":.,") in CLUES else c) for c, i in self.clues.items()}
        n_shape, n_clue = len(self.shapes) + 1, len(CLUES) + 1
        self.n_clue = n_clue
        self.size = n_shape * n_clue
        symbols = [[self._symbol(w) * (w.lower() not in (before, after)) for before, w, after in zip(["", *low], s, [*low[1:], ""])] for s, low in ((s, [w.lower() for w in s]) for s in words)]
        tags = [[t for _, t in s] for s in sentences]
        self.scores = self._train(symbols, tags, n_shape, rounds)
        clue_hash = np.array([_key(c) for c in self.clues], dtype=np.uint64)
        order = np.argsort(clue_hash)
        self.clue_hash = clue_hash[order]
        self.clue_number = np.array([self.clue_kind[i] for i in self.clues.values()], dtype=np.int64)[order]
        self.shape_hash: dict[int, np.ndarray] = {}

    def _spread(self, line: str, rnd: np.random.Generator) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        for part in re.findall(r"\{[^}]*\}\S*|\S+", line):
            if part[0] == "_":
                fill = list(rnd.choice(FILL, rnd.integers(1, 6)))
                fill[-1] += part[1:]
                out += [(str(w), 0) for w in fill]
            elif part[0] == "{":
                kind, body = part[1:].split(":", 1)
                body, tail = body.split("}", 1)
                k = 1 + 2 * FIELD_KINDS.index(kind)
                own = body.split(" ")
                own[-1] += tail
                out += [(w, k + (i > 0)) for i, w in enumerate(own)]
            else:
                out.append((part, 0))
        return out

    def _symbol(self, word: str) -> int:
        clue = self.clues.get(word.lower(), 0)
        return self.shapes.get(shape(word), 0) * self.n_clue + (self.clue_kind[clue] if clue else 0)

    #: Neighbours that a word's tag looks at.
    NEAR = (-3, -2, -1, 0, 1)

    def _train(self, symbols: list, tags: list, n_shape: int, rounds: int) -> dict:
        """Penalised likelihood by gradient steps (Adam); forward and backward sums over all sentences at once."""
        count, longest = len(symbols), max(map(len, symbols))
        x = np.zeros((count, longest), dtype=np.int64)
        y = np.zeros((count, longest), dtype=np.int64)
        live = np.zeros((count, longest), dtype=bool)
        for i, (s, t) in enumerate(zip(symbols, tags)):
            x[i, : len(s)], y[i, : len(s)], live[i, : len(s)] = s, t, True
        shapes, clues = np.where(live, x // self.n_clue, 0), np.where(live, x % self.n_clue, 0)
        near = {d: (self._moved(shapes, d), self._moved(clues, d)) for d in self.NEAR}
        w = {("s", d): np.zeros((n_shape, TAGS)) for d in self.NEAR} | {("c", d): np.zeros((self.n_clue, TAGS)) for d in self.NEAR}
        w |= {"t": np.zeros((TAGS, TAGS)), "b": np.zeros(TAGS)}
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        gold = np.eye(TAGS)[y] * live[..., None]
        allowed = self._allowed()
        for step in range(1, rounds + 1):
            e = w["b"] + sum(w["s", d][near[d][0]] + w["c", d][near[d][1]] for d in self.NEAR)
            t = np.where(allowed, w["t"], -1e4)
            p, pair = self._marginals(e, t, live)
            gap = gold - p
            pairs_gold = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
            grad = {"t": pairs_gold - pair, "b": gap.sum((0, 1))}
            flat = gap.reshape(-1, TAGS)
            for d in self.NEAR:
                for k, source in (("s", near[d][0]), ("c", near[d][1])):
                    cell = source.reshape(-1, 1) * TAGS + np.arange(TAGS)
                    grad[k, d] = np.bincount(cell.reshape(-1), flat.reshape(-1), w[k, d].size).reshape(-1, TAGS)
            for k in w:
                g = grad[k] - 0.3 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] = w[k] + 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        out = {"t": np.where(allowed, w["t"], -1e4).astype(np.float32), "b": w["b"].astype(np.float32)}
        number = np.arange(self.size)
        for d in self.NEAR:  # one table for each neighbour, by symbol
            out[d] = (w["s", d][number // self.n_clue] + w["c", d][number % self.n_clue]).astype(np.float32)
        return out

    @staticmethod
    def _moved(a: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros_like(a)
        if d < 0:
            out[:, -d:] = a[:, :d]
        elif d:
            out[:, :-d] = a[:, d:]
        else:
            out[:] = a
        return out

    @staticmethod
    def _allowed() -> np.ndarray:
        """Inside follows only begin or inside of its own kind."""
        ok = np.ones((TAGS, TAGS), dtype=bool)
        for k in range(len(FIELD_KINDS)):
            ok[:, 2 + 2 * k] = False
            ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
        return ok

    @staticmethod
    def _marginals(e: np.ndarray, t: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each tag at each word, and the expected number of each pair of tags: forward and backward sums,
        scaled at each word to add up to one."""
        longest = e.shape[1]
        e, t = np.exp(e - e.max(2, keepdims=True)), np.exp(t)
        ahead, back, scale = e.copy(), np.ones_like(e), np.ones(e.shape[:2])
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for i in range(1, longest):
            new = (ahead[:, i - 1] @ t) * e[:, i]
            scale[:, i] = np.where(live[:, i], new.sum(1), 1.0)
            ahead[:, i] = np.where(live[:, i, None], new / scale[:, i, None], ahead[:, i - 1])
        pair = np.zeros_like(t)
        for i in range(longest - 2, -1, -1):
            later = np.where(live[:, i + 1, None], e[:, i + 1] * back[:, i + 1] / scale[:, i + 1, None], 0.0)
            pair += t * (ahead[:, i].T @ later)
            back[:, i] = np.where(live[:, i + 1, None], later @ t.T, 1.0)
        return ahead * back * live[..., None], pair

    def symbols(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray, line: np.ndarray) -> np.ndarray:
        size = 1 << max(16, int(len(data) + 2).bit_length())
        if size not in self.shape_hash:  # the hash scale depends on the slice's size class
            self.shape_hash[size] = self._shape_table(size)
        known, number = self.shape_hash[size]
        out = self._look(known, number, shape_hashes(data, begin, end, size)) * self.n_clue + self._look(self.clue_hash, self.clue_number, words)
        twin = np.flatnonzero((words[1:] == words[:-1]) & (line[1:] == line[:-1]))
        out[twin] = out[twin + 1] = 0
        return out

    def _shape_table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        names = list(self.shapes)
        hashes = np.array([_shape_hash(s, size) for s in names], dtype=np.uint64)
        order = np.argsort(hashes)
        return hashes[order], np.array([self.shapes[s] for s in names], dtype=np.int64)[order]

    @staticmethod
    def _look(known: np.ndarray, number: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, number[at], 0)

    def decode(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best tag of each word; sequence i holds the words begin[i] .. begin[i] + size[i] - 1."""
        n = len(symbols)
        best = np.zeros(n, dtype=np.int8)
        if not n:
            return best
        s = self.scores
        line = np.repeat(np.arange(len(size)), size)
        e = np.broadcast_to(s["b"], (n, TAGS)).copy()
        for d in self.NEAR:
            other = np.arange(n) + d
            inside = (other >= 0) & (other < n)
            other = np.clip(other, 0, n - 1)
            inside &= line[other] == line
            e += s[d][np.where(inside, symbols[other], 0)]
        order = np.argsort(-size, kind="stable")
        start, length = begin[order], size[order]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        back = np.zeros((n, TAGS), dtype=np.int8)
        score = e[start]
        ends = np.zeros((len(start), TAGS), dtype=np.float32)
        t_in = s["t"].T.copy()  # by tag, then the tag before
        for i in range(1, int(length[0])):
            k = active[i]
            ends[k : len(score)] = score[k:]
            ways = score[:k, None, :] + t_in
            step = ways.argmax(2)
            back[start[:k] + i] = step
            score = np.take_along_axis(ways, step[..., None], 2)[..., 0] + e[start[:k] + i]
        ends[: len(score)] = score
        tag = ends.argmax(1).astype(np.int8)
        best[start + length - 1] = tag
        for i in range(int(length[0]) - 1, 0, -1):
            k = active[i]
            here = start[:k] + i
            # lanes whose last word is at i begin with their own best tag
            best[here - 1] = back[here, best[here]]
        return best


def shape_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    kind = _CLASS[data]
    same = np.zeros(len(kind), dtype=bool)
    same[1:] = kind[1:] == kind[:-1]
    drop = same & ((kind == ord("x")) | (kind == ord("X")))
    digit = kind == ord("d")
    drop[4:] |= digit[4:] & digit[3:-1] & digit[2:-2] & digit[1:-3] & digit[:-4]
    keep = ~drop
    kept = np.concatenate(([0], np.cumsum(keep)))
    first, last = kept[begin], kept[end]
    signs = finalised(np.arange(257, dtype=np.uint64))[kind[keep].astype(np.int64) + 1]
    up = _shape_powers(size)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(signs * up[: len(signs)])))
        return finalised((sums[last] - sums[first]) * up[size - 1 - first] + (last - first).astype(np.uint64))


def _shape_hash(text: str, size: int) -> int:
    mask, base, h = 0xFFFFFFFFFFFFFFFF, 0x9E3779B97F4A7C55, 0
    signs = finalised(np.arange(257, dtype=np.uint64))
    for i, b in enumerate(text.encode("latin-1")):
        h = (h + int(signs[b + 1]) * pow(base, size - 1 + i, 1 << 64)) & mask
    return int(finalised(np.array([(h + len(text)) & mask], dtype=np.uint64))[0])


@functools.cache
def field() -> Field:
    return Field()


def field_spans(column: pa.Array, model: Field) -> list[list[tuple[int, int, int]]]:
    """For each text (start, kind number, end) in code points of what the field finds; signs around a span are left out."""
    data, starts, size = joined(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in starts]
    begin, end, words = word_places(data)
    if not len(begin):
        return out
    line = np.cumsum((data == 10) | (data == 0))[begin]
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    tags = model.decode(model.symbols(data, begin, end, words, line), first, np.diff(np.append(first, len(begin))))
    opened = np.flatnonzero((tags & 1) == 1)
    if not len(opened):
        return out
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    for i in opened.tolist():
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1 and line[j] == line[i]:
            j += 1
        a, b = int(begin[i]), int(end[j - 1])
        raw = data[a:b].tobytes()
        b -= len(raw) - len(raw.rstrip(b".,;:!?)\"'"))
        a += len(raw) - len(raw.lstrip(b"(\"'"))
        if a < b:
            d = int(np.searchsorted(starts, a, side="right")) - 1
            zero = before[starts[d]]
            out[d].append((int(before[a] - zero), len(KINDS) + int(tags[i]) // 2, int(before[b] - zero)))
    return out


def spans_of(column: pa.Array, model: Field) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the base ones, and those of the field that overlap none of them; by start, then kind."""
    out = []
    for text, more in zip(texts_of(column), field_spans(column, model)):
        base = base_spans(text)
        begin, reach = [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]  # reach: where the first i spans end
        out.append(sorted(base + [x for x in more if reach[bisect_left(begin, x[2])] <= x[0]]))
    return out


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``found``, an array of (kind, start, end) in code points."""
    model = field()
    names = KINDS + FIELD_KINDS

    def fn(batch: pa.RecordBatch) -> dict:
        found = spans_of(batch.column(1), model)
        return {"doc_id": batch.column(0), "found": [[{"kind": names[k], "start": s, "end": e} for s, k, e in one] for one in found]}

    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], "doc_id long, found array<struct<kind:string,start:long,end:long>>", fn)


def report(df: DataFrame) -> DataFrame:
    """The digest columns of the registered query, from the operator's spans."""
    from inkwell.llm.common import span_report

    return span_report(scan_pii(df), KINDS)
