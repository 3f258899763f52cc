"""Licence scan: Aho-Corasick over the words of a text finds notice phrases and identifier tags; a shunting-yard parser
reads the and/or/with expression that follows a tag.

Texts become streams of words parted by one space (A-Z lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), so
a phrase is a plain byte string there, and its first word's number is a count of spaces. A null text counts as empty;
every input row gives one row. Memory is bounded by a slice of about 2 MB of text (or one text, if longer).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import automaton
from inkwell.llm.common import lengths, map_texts, texts_of

# The phrases and labels of the query's contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases that the method adds, and how strongly each speaks for a licence notice.
ADDED = {
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "apache license": ("apache", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "isc license": ("isc", 0.8),
    "creative commons": ("cc", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "dedicated to the public domain": ("public-domain", 0.9),
    "licensed under": ("licensed", 0.5),
    "used with permission": ("permission", 0.4),
}
BASE_WEIGHT = 0.8
TAG = "spdx license identifier"
#: Licences whose terms allow reuse with notice at most; what an expression is evaluated against.
PERMITTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})

_PHRASES = [*BASE, *ADDED, TAG]
_LABELS = [*BASE.values(), *(label for label, _ in ADDED.values())]
_WEIGHTS = [*([BASE_WEIGHT] * len(BASE)), *(w for _, w in ADDED.values())]

_WORD = np.full(256, 32, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32


@functools.cache
def matcher() -> automaton.Automaton:
    return automaton.phrases([f" {p} ".encode() for p in _PHRASES])


# ---- expressions ----------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(text: str) -> list[str]:
    """The expression at the beginning of ``text`` in postfix order ('with' binds closest, then 'and', then 'or').

    It ends where the grammar does: at the end of the line, at a sign that no expression holds, or before an operand
    that follows an operand. Brackets without partners and operators without operands are left out.
    """
    line = text.split("\n", 1)[0]
    out: list[str] = []
    wait: list[str] = []
    at, operand = 0, False  # whether an operand came last
    while m := _TOKEN.match(line, at):
        token, low = m[1], m[1].lower()
        if low in _BINDS:
            if not operand:
                break
            while wait and wait[-1] != "(" and _BINDS[wait[-1]] >= _BINDS[low]:
                out.append(wait.pop())
            wait.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            wait.append(token)
        elif token == ")":
            if not operand or "(" not in wait:
                break
            while wait[-1] != "(":
                out.append(wait.pop())
            wait.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
        at = m.end()
    if not operand and wait and wait[-1] in _BINDS:
        wait.pop()
    return out + [t for t in reversed(wait) if t != "("]


def permitted(steps: list[str], allowed: frozenset = PERMITTED) -> bool | None:
    """Evaluates a postfix expression: 'or' needs one side, 'and' both; an exception ('with') leaves its licence's value."""
    stack: list[bool] = []
    for step in steps:
        if step in _BINDS:
            if len(stack) < 2:
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if step == "or" else left and right if step == "and" else left)
        else:
            stack.append(step.rstrip("+") in allowed or step in allowed)
    return all(stack) if stack else None


# ---- scanning -------------------------------------------------------------------------------------------------


def scan(column: pa.Array) -> list[dict]:
    """One record for each text: n_words, places (phrase number, first word) in order, and expressions (postfix)."""
    size = lengths(column)
    n = len(size)
    raw = (" " + " \0 ".join(texts_of(column)) + " \0").encode("utf-8")
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = 1 + np.concatenate(([0], np.cumsum(size + 3)[:-1])).astype(np.int64)
    words = _WORD[data]
    words[starts + size + 1] = 0
    keep = np.ones(len(words), dtype=bool)
    space = words == 32
    keep[1:] = ~(space[1:] & space[:-1])
    stream = words[keep]
    gaps = np.cumsum(stream == 32)
    ends = np.flatnonzero(stream == 0)  # one for each text
    first = np.concatenate(([0], ends[:-1] + 1))
    at_first = gaps[first]
    out = [{"n_words": int(w), "places": [], "expressions": []} for w in gaps[ends] - at_first]
    place, bits = matcher().scan(stream)
    if not len(place):
        return out
    doc = np.searchsorted(ends, place, side="left")
    kept = None
    sizes = [len(p) + 2 for p in _PHRASES]
    tag = len(_PHRASES) - 1
    for end, bit, d in zip(place.tolist(), bits.tolist(), doc.tolist()):
        while bit:
            low = bit & -bit
            k = low.bit_length() - 1
            bit ^= low
            if k == tag:
                if kept is None:
                    kept = np.flatnonzero(keep)
                begin = int(kept[end])
                line = raw[begin : int(starts[d] + size[d])].decode("utf-8", "ignore") if begin < starts[d] + size[d] else ""
                if steps := postfix(line.lstrip(" \t:=")):
                    out[d]["expressions"].append(steps)
            else:
                out[d]["places"].append((k, int(gaps[end - sizes[k] + 1] - at_first[d])))
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, base places and labels, all labels, a score and whether the tags' expressions permit reuse.

    ``score`` is the chance that a notice is there, taking the phrases' weights as independent: 1 - product of (1 - weight)
    over distinct labels; a tag with an expression counts 0.95. ``permitted`` is null without an expression.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permitted")}
        for one in scan(batch.column(1)):
            base = [w for k, w in one["places"] if k < len(BASE)]
            labels = {_LABELS[k]: _WEIGHTS[k] for k, _ in one["places"]}
            miss = 1.0
            for label in sorted(labels):
                miss *= 1 - labels[label]
            names = {t for steps in one["expressions"] for t in steps if t not in _BINDS}
            miss *= 0.05 if names else 1.0
            verdicts = [v for steps in one["expressions"] if (v := permitted(steps)) is not None]
            out["n_words"].append(one["n_words"])
            out["n_base"].append(len(base))
            out["first_word"].append(min(base) if base else None)
            out["last_word"].append(max(base) if base else None)
            out["base_labels"].append(",".join(sorted({_LABELS[k] for k, _ in one["places"] if k < len(BASE)})))
            out["labels"].append(",".join(sorted({*labels, *(f"spdx:{t}" for t in names)})))
            out["score"].append(1 - miss)
            out["permitted"].append(all(verdicts) if verdicts else None)
        return out | {"doc_id": batch.column(0)}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean"
    return map_texts(df, [df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")], schema, fn)
