from pyspark.sql import functions as F

from inkwell.functions import dates, ids, keywords, url
from inkwell.functions import text as tx


def mapped(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_canonical_url(spark):
    cases = {
        "  HTTP://User:pw@Example.ORG:80?utm_source=a&b=2&A=1#top ": "http://example.org/?A=1&b=2",
        "https://example.org:443/p": "https://example.org/p",
        "https://example.org:8443/p?x=a+b&x=%2F": "https://example.org:8443/p?x=%2F&x=a+b",
        "https://example.org:0/": "https://example.org/",
        "https://example.org:99999/": None,
        "https://example.org:x/": None,
        "mailto:a@b.c": "mailto:a@b.c",
        "": "",
        "https://[2001:DB8::1]:8080/x": "https://2001:db8::1:8080/x",
        "https://example.org/a?fbclid=1&GCLID=2&id=7&empty=": "https://example.org/a?empty=&id=7",
        "https://example.org/a?q=%zz~*": "https://example.org/a?q=%25zz~%2A",
        "ht\ntps://example.org/a\tb": "https://example.org/ab",
        "https:///x": "https:///x",
    }
    assert mapped(spark, list(cases), url.canonical_url) == list(cases.values())


def test_canonical_url_is_idempotent(spark):
    values = ["http://a.example/?b=1&a=%20x", "https://a.example/%7Ex?y=z+%26", "https://b.example/p;q?x"]
    once = mapped(spark, values, url.canonical_url)
    assert mapped(spark, once, url.canonical_url) == once


def test_white_space(spark):
    assert mapped(spark, ["  a  b\x1c", "", "​"], tx.collapse_strip) == ["a b", "", "​"]
    assert mapped(spark, ["", "a", "a\n", "a\r\nb\x0bc", "\n"], tx.split_lines) == [[], ["a"], ["a"], ["a", "b", "c"], [""]]


def test_trim_and_summary(spark):
    assert mapped(spark, ["short", "one two, three", "abcdefghijkl"], lambda c: tx.trim_to_word(c, 10)) == ["short", "one two…", "abcdefghi…"]
    said = mapped(spark, ["Lead text. Abstract: First one. Second one! Third? Fourth.", "", "no stop", "x" * 170 + ". Abstract: y"], lambda c: tx.summary(F.lit("A title"), c))
    assert said[:3] == ["First one. Second one! Third?", "A title", "no stop"] and said[3].startswith("xxx")


def test_tokens_and_phrases(spark):
    assert mapped(spark, ["State-of-the-art, it's a GPU", "__none__", "a I x"], tx.tokens) == [["state-of", "the-art", "it's", "gpu"], ["none"], []]
    df = spark.createDataFrame([([" Chip ", "chip", "", "GPU"],)], "p array<string>")
    assert df.select(tx.clean_phrases(F.col("p")).alias("r")).first().r == ["Chip", "GPU"]


def test_identifiers(spark):
    assert mapped(spark, ["doi: 10.1000/ABC.", "https://doi.org/10.1000%2Fx", "see 10.1000/x", "10.1000/x rest", None], ids.doi) == ["10.1000/abc", "10.1000/x", None, None, None]
    assert mapped(spark, ["arXiv:2101.00001v2", "https://arxiv.org/pdf/2101.00001.pdf", "hep-th/0101001", "2101.1"], ids.arxiv) == ["2101.00001", "2101.00001", "hep-th/0101001", None]
    kinds = mapped(spark, ["10.1000/x", "https://www.arxiv.org/abs/2101.00001", "https://www.semanticscholar.org/paper/t/" + "aB" * 20, "https://example.org/p", "http://example.org/p", "https://10.0.0.1/", "https://u@example.org/"], ids.locator)
    assert [k and k.scheme for k in kinds] == ["doi", "arxiv", "s2", "url", None, None, None]


def test_dates(spark):
    cases = {
        "Tue, 05 Mar 2024 10:00:00 +0100": "2024-03-05T09:00:00+00:00",
        "5 Mar 2024 10:00 GMT": "2024-03-05T10:00:00+00:00",
        "2024-03-05T10:00:00.123Z": "2024-03-05T10:00:00+00:00",
        "2024-03-05": "2024-03-05T00:00:00+00:00",
        "2024-03-05T10:00": "2024-03-05T10:00:00+00:00",
        "next week": "next week",
        "": "",
        None: "",
    }
    assert mapped(spark, list(cases), dates.published_at) == list(cases.values())
    assert mapped(spark, ["2020", "2020-05-06", "", "spring " * 20], dates.normalized) == ["2020-01-01T00:00:00+00:00", "2020-05-06T00:00:00+00:00", None, ("spring " * 20).strip()[:64]]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Sparse tensor compiler", "A sparse tensor compiler for the sparse tensor cores. Fast."), (2, None, None)], "id int, title string, body string")
    rows = keywords.extract(df, "id", "title", "body").orderBy("rank").collect()
    assert (rows[0].keyword, rows[0].score) == ("sparse tensor compiler", round(4 * 2.1 + 2.1, 3))
    assert "sparse" not in [r.keyword for r in rows] and len(rows) <= 8


def test_rounding(spark):
    df = spark.createDataFrame([(1.00005,), (-0.00001,), (2.5,)], "x double")
    assert [r.r for r in df.select(tx.round_to(F.col("x"), 4).alias("r")).collect()][1:] == [0.0, 2.5]
    assert str(df.select(tx.round_to(F.lit(-0.00001), 4).alias("r")).first().r) == "0.0"


def test_vectors_and_labels(spark):
    from inkwell.functions import vectors

    df = spark.createDataFrame([([1.0, -0.5],), (None,), ([],)], "v array<float>")
    assert [r.r for r in df.select(vectors.unpack(vectors.pack("v")).alias("r")).collect()] == [[1.0, -0.5], None, []]
    assert df.select(vectors.unpack(F.lit(b"abc")).alias("r")).first().r is None
    assert mapped(spark, ["two_words-more", ""], ids.sentence_case) == ["Two words more", ""]
    assert mapped(spark, ["2101.00001", None], ids.arxiv_pdf) == ["https://arxiv.org/pdf/2101.00001", None]
