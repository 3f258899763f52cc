"""Deterministic automata over bytes: regexes by subset construction and minimisation, phrases by Aho-Corasick,
and one scan of a whole buffer in lockstep lanes.

A scan cuts the buffer into thousands of lanes and moves them all one byte at a time with two numpy gathers. Lanes
begin after bytes on which every state goes to the same one, so the cuts change no result.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np


@dataclass
class Automaton:
    """``table[state * width + classes[byte]]`` is the next state times ``width``; ``accept[state]`` a set of bits."""

    table: np.ndarray
    classes: np.ndarray
    accept: np.ndarray
    width: int

    def __post_init__(self) -> None:
        square = self.table.reshape(-1, self.width)
        same = (square == square[0]).all(axis=0)
        self.reset = same[self.classes]
        self.after = square[0][self.classes]
        self.hits = np.repeat(self.accept != 0, self.width)  # by scaled state

    def step(self, state: int, byte: int) -> int:
        return int(self.table[state + int(self.classes[byte])])

    def bits(self, state: int) -> int:
        return int(self.accept[state // self.width])

    def scan(self, data: np.ndarray, lanes: int = 4096, shortest: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Places (of the last byte) in ``data`` where the state accepts, rising, and their bits."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, self.accept.dtype)
        span = max(shortest, -(-n // lanes))
        cuts = np.flatnonzero(self.reset[data]) + 1
        want = np.arange(span, n, span)
        found = np.searchsorted(cuts, want)
        begin = np.unique(np.concatenate(([0], cuts[found[found < len(cuts)]])))
        begin = begin[begin < n]
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state = np.where(begin > 0, self.after[data[begin - 1]], 0).astype(self.table.dtype)
        kinds = self.classes[data]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lanes longer than t
        places, states = [], []
        table, hits = self.table, self.hits
        for t in range(int(size[0])):
            k = active[t]
            here = begin[:k] + t
            state = table.take(state[:k] + kinds.take(here))
            flags = hits.take(state)
            if flags.any():
                at = np.flatnonzero(flags)
                places.append(here[at])
                states.append(state[at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, self.accept.dtype)
        place, end = np.concatenate(places), np.concatenate(states)
        order = np.argsort(place, kind="stable")
        return place[order], self.accept[end[order] // self.width]


# ---- regexes -------------------------------------------------------------------------------------------------


class _Parser:
    """A regex over bytes as a tree: ('set', frozenset), ('cat', [..]), ('or', [..]), ('rep', node, least, most)."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.s, self.i, self.any_case = pattern, 0, any_case

    def parse(self) -> tuple:
        node = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def either(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom()
            while (c := self.peek()) and c in "?*+{":
                node = ("rep", node, *self.count())
            parts.append(node)
        return ("cat", parts)

    def count(self) -> tuple[int, int | None]:
        c = self.s[self.i]
        self.i += 1
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        body, self.i = self.s[self.i : (end := self.s.index("}", self.i))], end + 1
        low, comma, high = body.partition(",")
        return int(low), int(high) if high else (None if comma else int(low))

    def atom(self) -> tuple:
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self.either()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.bracket())
        return ("set", self.cased({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def bracket(self) -> frozenset:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = self.one()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.one() + 1))
            else:
                found.add(low)
        self.i += 1
        found = set(self.cased(found))
        return frozenset(set(range(256)) - found if negated else found)

    def one(self) -> int:
        c = self.s[self.i]
        self.i += 1
        return self.escape() if c == "\\" else ord(c)

    def cased(self, found: set[int]) -> frozenset:
        if not self.any_case:
            return frozenset(found)
        return frozenset(found | {b ^ 32 for b in found if 65 <= b & ~32 <= 90})

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""


def parse(pattern: str, any_case: bool = False) -> tuple:
    return _Parser(pattern, any_case).parse()


def backwards(node: tuple) -> tuple:
    """The tree of all the strings of ``node`` read from their ends."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", backwards(node[1]), node[2], node[3])
    parts = [backwards(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.skips: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []
        self.ends: dict[int, int] = {}

    def node(self) -> int:
        self.skips.append([])
        self.moves.append(None)
        return len(self.skips) - 1

    def add(self, tree: tuple, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.node()
            mid = self.node()
            self.skips[start].append(mid)
            self.moves[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.node()
        if kind == "or":
            for part in tree[1]:
                self.skips[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.node()
            self.skips[start].append(loop)
            self.skips[self.add(part, loop)].append(loop)
            self.skips[loop].append(end)
            return end
        for _ in range(most - least):
            self.skips[start].append(end)
            start = self.add(part, start)
        self.skips[start].append(end)
        return end


def compiled(trees: list[tuple], unanchored: bool) -> Automaton:
    """One minimal automaton for all the trees; bit i marks the end of a string of tree i (of any suffix, if unanchored)."""
    nfa = _Nfa()
    root = nfa.node()
    for i, tree in enumerate(trees):
        start = nfa.node()
        nfa.skips[root].append(start)
        nfa.ends[nfa.add(tree, start)] = 1 << i
    closure = []
    for s in range(len(nfa.skips)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.skips[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closure.append(sum(1 << x for x in seen if nfa.moves[x] is not None or x in nfa.ends))
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    kind_of: dict[tuple, int] = {}
    classes = np.array([kind_of.setdefault(tuple(b in s for s in sets), len(kind_of)) for b in range(256)], dtype=np.uint8)
    width = len(kind_of)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(width)]
    goes = [[0] * width for _ in nfa.moves]
    for s, move in enumerate(nfa.moves):
        if move:
            for c in range(width):
                if sample[c] in move[0]:
                    goes[s][c] = closure[move[1]]
    first = closure[root]
    number, order, rows = {first: 0}, [first], []
    for state in order:  # grows while it is walked
        row = [first if unanchored else 0] * width
        rest = state
        while rest:
            low = rest & -rest
            s = low.bit_length() - 1
            rest ^= low
            if nfa.moves[s]:
                go = goes[s]
                for c in range(width):
                    row[c] |= go[c]
        for c in range(width):
            if row[c] not in number:
                number[row[c]] = len(order)
                order.append(row[c])
        rows.append([number[x] for x in row])
    accept = np.array([sum(bit for s, bit in nfa.ends.items() if state >> s & 1) for state in order], dtype=np.int64)
    return minimal(np.array(rows, dtype=np.int32), classes, accept)


def minimal(square: np.ndarray, classes: np.ndarray, accept: np.ndarray) -> Automaton:
    """Merges states that no string tells apart (by refining the split by what they accept); state 0 stays first."""
    _, group = np.unique(accept, return_inverse=True)
    n = group.max() + 1
    while True:
        _, refined = np.unique(np.column_stack((group, group[square])), axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() + 1 == n:
            break
        group, n = refined, refined.max() + 1
    _, first = np.unique(group, return_index=True)
    rank = np.empty(n, dtype=np.int32)
    rank[np.argsort(first)] = np.arange(n)  # numbered as they first occur, so that the start is 0
    new = rank[group]
    table = np.empty((n, square.shape[1]), dtype=np.int32)
    table[new] = new[square]
    ends = np.empty(n, dtype=np.int64)
    ends[new] = accept
    width = square.shape[1]
    return Automaton((table * width).reshape(-1), classes, ends, width)


def phrases(words: list[bytes]) -> Automaton:
    """Aho-Corasick: bit i marks the end of word i; failure links are folded into the table."""
    used = sorted({b for w in words for b in w})
    classes = np.zeros(256, dtype=np.uint8)
    for c, b in enumerate(used, 1):
        classes[b] = c
    width = len(used) + 1
    rows, ends = [[-1] * width], [0]
    for i, word in enumerate(words):
        s = 0
        for b in word:
            c = classes[b]
            if rows[s][c] < 0:
                rows[s][c] = len(rows)
                rows.append([-1] * width)
                ends.append(0)
            s = rows[s][c]
        ends[s] |= 1 << i
    fail, todo = [0] * len(rows), deque([0])
    while todo:
        s = todo.popleft()
        for c in range(width):
            t = rows[s][c]
            back = rows[fail[s]][c] if s else 0
            if t < 0:
                rows[s][c] = back
            else:
                fail[t] = back
                ends[t] |= ends[back]
                todo.append(t)
    return Automaton((np.array(rows, dtype=np.int32) * width).reshape(-1), classes, np.array(ends, dtype=np.int64), width)
