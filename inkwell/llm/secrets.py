"""Secret scan: all rules as one minimal deterministic automaton, run over all bytes in one pass.

The automaton marks where the telling beginning of any rule's match ends (short ones, so that the product of all
rules stays small). From such a place the rule's own reversed automaton finds
the leftmost start, and its forward one the longest end, so the regexes themselves never scan a text. A null text
counts as empty; no row is dropped; repeated rows each give a row. Memory is bounded by a slice of about 2 MB of text
(or one text, if longer).
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import automaton
from inkwell.llm.common import joined, map_texts, small_batches, span_report


@dataclass(frozen=True)
class Rule:
    """``least`` is a beginning that every match has and that fixes its start; the shared automaton looks for these, all in
    one pass. ``whole`` is the full form, run from such a start; ``value_least``: characters that its last group needs."""

    kind: str
    least: str
    whole: str
    any_case: bool = False
    value_least: int = 0


# The base kinds of the query's contract.
_KEYS = "(password|passwd|secret|token|api_?key)"
_MID = "[\"']?\\x20*[:=]\\x20*[\"']?"
BASE = (
    Rule("assign", f"{_KEYS}{_MID}[A-Za-z0-9+/_.=-]", f"{_KEYS}{_MID}([A-Za-z0-9+/_.=-]+)", True, 6),
    Rule("access", "AKIA", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]{24,}"),
)
# Kinds that the method adds, from publicly documented token formats.
ADDED = (
    Rule("pem", "-----BEGIN ", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("githost", "gh[pousr]_", "gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("mapkey", "AIza", "AIza[A-Za-z0-9_-]{30,}"),
    Rule("pay", "[sr]k_(live|test)_", "[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    all: automaton.Automaton
    back: list[automaton.Automaton]
    ahead: list[automaton.Automaton]

    def spans(self, raw: bytes, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, leftmost non-overlapping for each rule; ``ends``: places where matches end, with bits."""
        out = []
        for r, rule in enumerate(self.rules):
            free = 0
            for last, bits in ends:
                if not bits >> r & 1 or last < free:
                    continue
                back, state, start = self.back[r], 0, -1
                for i in range(last, free - 1, -1):
                    state = back.step(state, raw[i])
                    if back.bits(state):
                        start = i
                    elif state == self._dead(back):
                        break
                if start < 0:
                    continue
                ahead, state, end = self.ahead[r], 0, start
                for i in range(start, len(raw)):
                    state = ahead.step(state, raw[i])
                    if ahead.bits(state):
                        end = i + 1
                    elif state == self._dead(ahead):
                        break
                if end == start:
                    continue
                free = end
                if rule.value_least and not self._value(rule, raw[start:end]):
                    continue
                out.append((start, r, end))
        return sorted(out)

    @staticmethod
    def _dead(a: automaton.Automaton) -> int:
        if not hasattr(a, "dead"):
            square = a.table.reshape(-1, a.width)
            own = np.arange(len(square))[:, None] * a.width
            stuck = np.flatnonzero((square == own).all(axis=1) & (a.accept == 0))
            a.dead = int(stuck[0]) * a.width if len(stuck) else -1
        return a.dead

    @staticmethod
    def _value(rule: Rule, found: bytes) -> bool:
        m = re.fullmatch(rule.whole.encode(), found, re.IGNORECASE if rule.any_case else 0)
        return m is not None and len(m[m.re.groups]) >= rule.value_least


@functools.cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    least = [automaton.parse(r.least, r.any_case) for r in rules]
    whole = [automaton.parse(r.whole, r.any_case) for r in rules]
    one = lambda tree: automaton.compiled([tree], unanchored=False)
    return Scanner(rules, automaton.compiled(least, unanchored=True), [one(automaton.backwards(t)) for t in least], [one(t) for t in whole])


def find(column: pa.Array, scan: Scanner) -> list[list[tuple[str, int, int]]]:
    """For each text its spans (kind, start, end) in code points, by start, then rule."""
    data, starts, size = joined(column)
    place, bits = scan.all.scan(data)
    out: list[list[tuple[str, int, int]]] = [[] for _ in starts]
    if not len(place):
        return out
    doc = np.searchsorted(starts, place, side="right") - 1
    for first, rows in _groups(doc):
        begin = int(starts[first])
        raw = data[begin : begin + int(size[first])].tobytes()
        ends = [(int(place[i]) - begin, int(bits[i])) for i in rows]
        chars = (lambda a, b, raw=raw: b - a) if raw.isascii() else (lambda a, b, raw=raw: len(raw[a:b].decode("utf-8")))
        for s, r, e in scan.spans(raw, ends):
            left = chars(0, s)
            out[first].append((scan.rules[r].kind, left, left + chars(s, e)))
    return out


def _groups(keys: np.ndarray):
    cut = np.flatnonzero(np.diff(keys)) + 1
    for rows in np.split(np.arange(len(keys)), cut):
        yield int(keys[rows[0]]), rows


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and ``found``, an array of (kind, start, end) in code points."""
    scan = scanner(rules)

    def fn(batch: pa.RecordBatch) -> dict:
        found = find(batch.column(1), scan)
        return {"doc_id": batch.column(0), "found": [[{"kind": k, "start": s, "end": e} for k, s, e in one] for one in found]}

    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], "doc_id long, found array<struct<kind:string,start:long,end:long>>", fn)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret of the text column replaced by ``mark`` (overlapping spans by one); a null text stays null."""
    small_batches(df.sparkSession)
    scan = scanner(rules)
    names, at = df.columns, df.columns.index(text_col)
    schema = df.schema

    def run(batches):
        from inkwell.llm.common import pieces

        for batch in pieces(batches, text=at):
            column = batch.column(at)
            found = find(column, scan)
            if any(found):
                texts = column.to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        texts[i] = _replaced(texts[i], [(s, e) for _, s, e in spans], mark)
                arrays = [pa.array(texts, type=f.type) if i == at else batch.column(i) for i, f in enumerate(batch.schema)]
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return df.select(*names).mapInArrow(run, schema)


def _replaced(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, free = [], 0
    for s, e in sorted(spans):
        if s >= free:
            out += [text[free:s], mark]
        free = max(free, e)
    return "".join([*out, text[free:]])


def report(df: DataFrame) -> DataFrame:
    """The digest columns of the registered query, from the operator's spans."""
    return span_report(scan_secrets(df), tuple(r.kind for r in BASE))
