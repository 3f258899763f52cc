"""Secrets, personal data and licences against plain regexes over the same texts."""

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest
from conftest import EDGES, documents  # noqa: F401
from pyspark.sql import functions as F

from inkwell.llm import automaton, licenses, pii, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def noise(seed, pieces, n=400, most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_secrets_equal_regexes():
    parts = ["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "A1B2C3D4", "deadbeef01", "é", "\n", "\0", "xyz.", "passwd", "ſ"]
    texts = noise(1, parts) + ["token = secret=abcdefgh", "AKIAAKIA" + "A" * 20, "", "token=ab token=abcdef", "a" * 100]
    base = {r.kind for r in secrets.BASE}
    for text, found in zip(texts, secrets.find(pa.array(texts), secrets.scanner())):
        assert [x for x in found if x[0] in base] == plain_secrets(text)


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("pem", "-----BEGIN RSA PRIVATE KEY-----"), ("jwt", "eyJhbGciOi.eyJzdWIi.sig_nature"), ("githost", "ghp_" + "a1" * 18),
        ("chat", "xoxb-1234567890-abc"), ("mapkey", "AIza" + "x" * 35), ("pay", "sk_live_" + "9" * 20),
    ],
)
def test_added_kinds(kind, text):
    found = secrets.find(pa.array([f"é {text} end", text[:-1] if kind == "pem" else text[:8]]), secrets.scanner())
    assert (kind, 2, 2 + len(text)) in found[0] and not any(x[0] == kind for x in found[1])


def test_secret_report_and_redaction(spark, edge_docs, no_docs):
    rows = secrets.report(edge_docs.unionByName(documents(spark, [(20, "é token: abcdef12 x")]))).collect()
    assert len(rows) == len(EDGES) + 1
    by = {r.doc_id: r for r in rows}
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by[20].n_assign, by[20].spans, by[20].base_sha256) == (1, "assign:2:17", hashlib.sha256(b"assign:2:17").hexdigest())
    assert secrets.report(no_docs).count() == 0
    clean = secrets.redact(documents(spark, [(1, "a token=abcdef1234567890abcdef1234 b"), (2, None)]))
    assert clean.columns == edge_docs.columns and {r.doc_id: r.text for r in clean.collect()} == {1: "a [SECRET] b", 2: None}


def test_automaton_is_minimal_and_lanes_agree():
    import numpy as np

    a = automaton.compiled([automaton.parse("ab|cab{2,3}"), automaton.parse("[x-z]+q?")], unanchored=True)
    rnd = np.random.default_rng(0)
    data = np.frombuffer(bytes(rnd.choice(np.frombuffer(b"abcxyzq\n", np.uint8), 50_000)), np.uint8)
    state, want = 0, []
    for i, b in enumerate(data):
        state = a.step(state, int(b))
        if a.bits(state):
            want.append((i, a.bits(state)))
    for lanes in (1, 7, 4096):
        place, bits = a.scan(data, lanes=lanes, shortest=16)
        assert list(zip(place.tolist(), bits.tolist())) == want
    one = automaton.compiled([automaton.parse("(a|b)(a|b)")], unanchored=False)
    assert len(one.accept) == 4  # start, one sign, two signs, nothing


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_regexes():
    parts = list("aB1.@-+ ()9é0") + ["@", ".", " 4111 1111 1111 1111", "255.255.1.1", "+1 (212) 555-0100"]
    for text in noise(2, parts, 3000):
        assert pii.base_spans(text) == plain_pii(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("0" * 5000 + ".1.1.1", [(0, 1, 5006)]), ("7" * (1 << 20), []), ("1." * (1 << 19), [(8 * i, 1, 8 * i + 7) for i in range(1 << 17)]),
        ("1 " * (1 << 19), []), ("+1" + "(" * (1 << 20), []), ("a@" * (1 << 19), []), ("9" * 5000 + ".1.1.1 1.2.3.4", [(5007, 1, 5014)]),
    ],
    ids=["zeros", "digits", "dots", "spaced", "signs", "ats", "large"],
)
def test_long_runs_take_linear_time(text, found):
    began = time.time()
    assert pii.base_spans(text) == found and time.time() - began < 2


def test_field_on_marked_sentences_it_never_saw():
    import marked

    field, names = pii.field(), pii.KINDS + pii.FIELD_KINDS
    learned = {re.sub(r"[{}]|\w+:", "", line).strip("_ ") for line in pii.EXAMPLES}
    assert not learned & {marked.parts(line)[0] for line in marked.MARKED}
    recall, precision = marked.measured(lambda text: [(names[k], s, e) for s, k, e in pii.field_spans(pa.array([text]), field)[0]])
    assert recall >= 0.95 and precision >= 0.95


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(3)
    e, t = rnd.normal(size=(2, 4, pii.TAGS)), np.where(pii.Field._allowed(), rnd.normal(size=(pii.TAGS, pii.TAGS)), -1e4)
    live = np.array([[True] * 4, [True, True, False, False]])
    p, pair = pii.Field._marginals(e, t, live)
    pairs = np.zeros_like(t)
    for s, n in ((0, 4), (1, 2)):
        ways = list(itertools.product(range(pii.TAGS), repeat=n))
        weight = np.exp([sum(e[s, i, k] for i, k in enumerate(w)) + sum(t[a, b] for a, b in zip(w, w[1:])) for w in ways])
        weight /= weight.sum()
        for i in range(n):
            assert np.allclose(p[s, i], np.bincount([w[i] for w in ways], weight, pii.TAGS))
        for i in range(1, n):
            np.add.at(pairs, ([w[i - 1] for w in ways], [w[i] for w in ways]), weight)
    assert np.allclose(pair, pairs) and not p[1, 2:].any()


def test_added_spans_never_overlap_base_ones():
    rnd = random.Random(8)
    parts = ["my name is Anna Keller ", "DOB: 04/05/1986 ", "SSN: 321-54-9876 ", "a.b@c.de ", "+1 212 555 0100 ", "é, ", "4111 1111 1111 1111 ", "Mr. 1.2.3.4 ", "contact bob [at] mail [dot] org\n", "Mr. Tom.B@c.de "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(200)]
    more = pii.field_spans(pa.array(texts), pii.field())
    for text, found, added in zip(texts, pii.spans_of(pa.array(texts), pii.field()), more):
        base = plain_pii(text)
        assert found == sorted(base + [x for x in added if all(x[2] <= s or x[0] >= e for s, _, e in base)])


def test_field_decodes_as_plain_viterbi():
    import numpy as np

    m = pii.field()
    rnd = np.random.default_rng(0)
    size = np.array([1, 9, 2, 30, 1])
    begin = np.cumsum(size) - size
    symbols = rnd.integers(0, m.size, size.sum())
    tags = m.decode(symbols, begin, size)
    for b, n in zip(begin, size):
        x, s = symbols[b : b + n], m.scores
        e = [s["b"] + sum(s[d][x[i + d] if 0 <= i + d < n else 0] for d in m.NEAR) for i in range(n)]
        score, back = e[0], []
        for i in range(1, n):
            ways = score[:, None] + s["t"]
            back.append(ways.argmax(0))
            score = ways.max(0) + e[i]
        best = [int(score.argmax())]
        for way in back[::-1]:
            best.append(int(way[best[-1]]))
        assert list(tags[b : b + n]) == best[::-1]


def test_field_finds_what_only_context_tells(spark):
    text = "thon ed my name is Greta Olsen and the SSN: 321-54-9876, lives at 55 Birch Road thtion.\nDear Mr. Kowalski, erti é DOB 04/05/1986"
    spans = pii.spans_of(pa.array([text]), pii.field())[0]
    names = pii.KINDS + pii.FIELD_KINDS
    assert {(names[k], text[s:e]) for s, k, e in spans} >= {("name", "Greta Olsen"), ("identity", "321-54-9876"), ("name", "Kowalski"), ("address", "55 Birch Road"), ("birth", "04/05/1986")}


def test_field_leaves_clean_documents_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    added = pii.scan_pii(docs).select(F.explode("found").alias("x")).where(~F.col("x.kind").isin(*pii.KINDS))
    assert added.count() <= 3


def test_pii_edges(spark, edge_docs, no_docs):
    rows = pii.report(edge_docs).collect()
    assert len(rows) == len(EDGES) and all(r.n_email == 0 for r in rows) and pii.report(no_docs).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licences_equal_word_search():
    parts = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "reserved", "é", "\0", "\n", "1", " ", "--", "İ", "sa"]
    texts = noise(3, [p + e for p in parts for e in ("", " ", "-")], 1500) + ["", "cc", "cc by cc by", None]
    phrases = [p.split() for p in licenses._PHRASES[:-1]]
    for text, found in zip(texts, licenses.scan(pa.array(texts))):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        assert found["n_words"] == len(w)
        assert sorted((i, k) for k, i in found["places"]) == sorted((i, k) for k, p in enumerate(phrases) for i in range(len(w)) if w[i : i + len(p)] == p)


def test_expressions():
    assert licenses.postfix("MIT OR (Apache-2.0 AND GPL-2.0+ WITH Classpath) foo") == ["mit", "apache-2.0", "gpl-2.0+", "classpath", "with", "and", "or"]
    assert licenses.postfix("MIT OR\nISC") == ["mit"] and licenses.postfix(")(") == [] and licenses.postfix("(MIT") == ["mit"] and licenses.postfix("") == []
    assert [licenses.permitted(licenses.postfix(x)) for x in ("MIT or GPL-2.0", "MIT and GPL-2.0", "GPL-2.0 and mit or isc", "")] == [True, False, True, None]


def test_licence_rows(spark, edge_docs, no_docs):
    docs = edge_docs.unionByName(documents(spark, [(30, "x SPDX-License-Identifier: MIT OR GPL-2.0\nAll rights reserved. CC BY")]))
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    r = rows[30]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.permitted) == (2, 9, 12, "cc-by,reserved", r.labels, True)
    assert "spdx:mit" in r.labels and 0 < r.score <= 1 and rows[1].score == 0 and rows[1].first_word is None
    assert licenses.scan_licenses(no_docs).count() == 0
