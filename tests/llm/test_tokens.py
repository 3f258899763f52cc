"""Token counts, ids and decoded texts against the installed library."""

import hashlib
import random

import public_tokenizers
import pytest
from conftest import EDGES, documents
from tokenizers import Tokenizer

from inkwell.llm import tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = "aAbBzZ ÉéèΣσςİıßẞﬁǅ漢字かな한글😀👍🏽́​ \t\n\r\x0b\x1c\x85'’s'll'RE0123456789½²!?.,<|>$%__ \0\xad﻿"


def texts():
    rnd = random.Random(3)
    out = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    out += [t for _, t in EDGES if t is not None]
    return out + ["hello<|endoftext|>World's <|startoftext|><|endoftext|>x", "a" * 3000, "<|ENDOFTEXT|>", "ab" * 700 + "!" * 500, "é" * 400, "don't we'LL"]


def test_counts_equal_the_library():
    lib = Tokenizer.from_file(BYTES)
    count = tokens.counter(BYTES).count
    for t in texts():
        assert count(t) == len(lib.encode(t, add_special_tokens=False).ids), t[:60]


def test_ids_and_texts_equal_the_library():
    lib = Tokenizer.from_file(WORDS)
    enc = tokens.encoder(WORDS)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids, t[:60]
        assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_backtracking_equals_merges():
    enc = tokens.encoder(WORDS)
    rnd = random.Random(5)
    for _ in range(5000):
        word = "".join(rnd.choice(["th", "er", "in", "on", "a", "e", "ing", "z", "tion", "q", "é"]) for _ in range(rnd.randint(1, 9)))
        letters = word.encode().decode("latin-1").translate(enc.table)
        assert enc.ids(word) == enc.merged(letters), word


def test_long_merges_equal_short_ones():
    c = tokens.counter(BYTES)
    rnd = random.Random(6)
    for _ in range(200):
        piece = "".join(rnd.choice("thernoi ") for _ in range(rnd.randint(40, 64))).encode()
        assert c.merged(piece) == tokens._merged_long([c.one[b] for b in piece], c.rank)


def test_memo_keeps_results_when_it_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    memo = tokens.Memo(len)
    for _ in range(3):
        for word in map(str, range(90, 120)):
            assert memo[word] == len(word)
    assert len(memo) <= 5 and len(memo.old) <= 5


def test_rows(spark, edge_docs, no_docs):
    counted = tokens.count_tokens(edge_docs, BYTES, limit=3).collect()
    assert len(counted) == len(EDGES)
    by = {r.doc_id: r for r in counted}
    assert (by[1].n_tokens, by[1].n_bytes, by[1].over_limit) == (0, 0, False) and by[6].over_limit
    lib = Tokenizer.from_file(WORDS)
    for r in tokens.encode_with_digests(edge_docs, WORDS).collect():
        text = dict(EDGES)[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = tokens.encode_with_digests(documents(spark, [(1, "Hello there")]), WORDS)
    assert tokens.decode_ids(coded, WORDS).first().decoded == lib.decode(coded.first().ids, skip_special_tokens=False)
    assert tokens.encode_digests(no_docs, WORDS).count() == tokens.count_tokens(no_docs, BYTES).count() == 0


def test_missing_file_fails_on_the_driver(edge_docs):
    with pytest.raises(FileNotFoundError):
        tokens.count_tokens(edge_docs, "/nowhere.json")


def test_long_words_are_not_remembered():
    memo = tokens.Memo(len)
    assert memo["x" * 5000] == 5000 and memo["short"] == 5 and list(memo) == ["short"]


def test_decoding_takes_null_ids_and_an_empty_table(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (None, [320])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in tokens.decode_ids(rows, WORDS).collect()} == {1: "", 2: "", None: tokens.encoder(WORDS).decode([320])}
    assert tokens.decode_ids(rows.where("false"), WORDS).count() == 0
