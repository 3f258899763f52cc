"""Keywords of a paper: weighted runs of one to three words, the best eight without words that a chosen phrase holds."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import round_to

# Fixed value: what counts as a word of a keyword.
WORD = r"(?i)[a-z](?:[a-z0-9+.-]*[a-z0-9+])?"
# Fixed value: words that no keyword holds.
STOP_WORDS = (
    "about after against also among and are based been before being between both but can could does each for from have into its more most not our over"
    " paper results show such than that the their these they this through using was were which while with within without would you"
).split()


def words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), 0), F.lower)


def stop_flags(tokens: Column) -> Column:
    """Which of the words are stop words. To be a column of its own: each word is looked up once."""
    return F.transform(tokens, lambda w: w.isin(*STOP_WORDS))


def phrases(tokens: Column, stops: Column, weight: float) -> Column:
    """array of struct(phrase, w): all runs of up to three words without stop words; ``stops`` flags the words."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        fine = F.filter(starts, lambda i: ~functools.reduce(Column.__or__, (F.get(stops, i + k) for k in range(n))))
        return F.transform(fine, lambda i: F.struct(F.concat_ws(" ", *(F.get(tokens, i + k) for k in range(n))).alias("phrase"), F.lit(weight * (1 + 0.55 * (n - 1))).alias("w")))

    return F.concat(*map(of_length, (1, 2, 3)))


def ranked(scored: Column) -> Column:
    """Sorted by score, then more words, then the phrase; of struct(phrase, score)."""
    spaces = lambda p: F.size(F.split(p, " "))
    keyed = F.transform(scored, lambda s: F.struct((-s["score"]).alias("a"), (-spaces(s["phrase"])).alias("b"), s["phrase"].alias("phrase"), s["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["phrase"].alias("phrase"), s["score"].alias("score")))


def chosen(candidates: Column, limit: int = 8) -> Column:
    """The first ``limit`` candidates that are no proper part (as sets of words) of one already chosen."""
    empty = F.array().cast("array<struct<phrase:string,score:double>>")

    def held(acc: Column, phrase: Column) -> Column:
        own = F.array_distinct(F.split(phrase, " "))
        def inside(other: Column) -> Column:
            theirs = F.array_distinct(F.split(other["phrase"], " "))
            return (F.size(own) < F.size(theirs)) & (F.size(F.array_except(own, theirs)) == 0)
        return F.exists(acc, inside)

    # a chosen phrase of three words holds at most 33 others (sequences of up to three of its words with fewer distinct
    # ones), so later candidates than these are never reached
    near = F.slice(candidates, 1, limit * 34)
    return F.aggregate(near, empty, lambda acc, c: F.when((F.size(acc) >= limit) | held(acc, c["phrase"]), acc).otherwise(F.concat(acc, F.array(c))))


def totals(df, id_col: str, title: str, body: str):
    """(id, phrase, score): summed by document and phrase, three decimals, phrases of four characters and more.

    Words are a column of their own first: inside a lambda the whole expression would be evaluated for each run."""
    split = df.select(id_col, words(F.col(title)).alias("_t"), words(F.col(body)).alias("_b"))
    split = split.select("*", stop_flags(F.col("_t")).alias("_ts"), stop_flags(F.col("_b")).alias("_bs"))
    rows = split.select(id_col, F.explode(F.concat(phrases(F.col("_t"), F.col("_ts"), 4.0), phrases(F.col("_b"), F.col("_bs"), 1.0))).alias("x")).where(F.char_length("x.phrase") >= 4)
    return rows.groupBy(id_col, F.col("x.phrase").alias("phrase")).agg(round_to(F.sum("x.w"), 3).alias("score"))


def extract(df, id_col: str, title: str, body: str, limit: int = 8):
    """(id, rank, keyword, score) of each document's keywords."""
    scored = totals(df, id_col, title, body).groupBy(id_col).agg(F.collect_list(F.struct("phrase", "score")).alias("all"))
    picked = scored.select(id_col, F.posexplode(chosen(ranked(F.col("all")), limit)).alias("p", "x"))
    return picked.select(id_col, (F.col("p") + 1).alias("rank"), F.col("x.phrase").alias("keyword"), F.col("x.score").alias("score"))
