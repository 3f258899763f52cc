import random

import pytest


def words(n, seed=0, pool=400):
    rnd = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ha", "ing", "ed", "is", "or", "es", "en", "st"]
    vocabulary = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(pool)]
    return [rnd.choice(vocabulary) for _ in range(n)]


#: Rows that every operator must take: null, empty and blank texts, a very long one, other scripts, repeats, a null id.
EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Ünïcode 漢字 😀 a b\u0000c"), (6, " ".join(words(30_000, 9))),
    (7, "same text here for two rows"), (7, "same text here for two rows"), (8, "same text here for two rows"), (None, "no id"), (9, "x" * 20_000),
]


def documents(spark, rows, clash=True):
    """A documents table with columns whose names clash with those that operators make."""
    full = [(i, t, "en", "src1", 0 if t is None else len(t), -1, "clash", None) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score int, found string, node string")
    return df if clash else df.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture
def edge_docs(spark):
    return documents(spark, EDGES)


@pytest.fixture
def no_docs(spark):
    return documents(spark, [])
