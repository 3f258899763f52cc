"""Relevance: TF-IDF in long form, cosines, source affinity, the weighted score, and learned thresholds."""

from __future__ import annotations

import functools
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as tx
from inkwell.operators import merge, paging
from inkwell.operators.shared import stored

# Weights of the score's parts, percentiles of a cold start, and the limits of learning.
WEIGHTS = {"interest": 70, "lexical": 25, "feedback": 15, "source": 5, "exclusion": -25}
INCLUDE_EACH, INCLUDE_MOST = 5, 10
PERCENTILES = {"broad": 0.70, "balanced": 0.90, "focused": 0.95}
KEEPS, DISCARDS, STEP, TRUE_POSITIVES = 5, 15, 3.0, 5
EMPTY_PERCENTILE = 50.0
RECENT = 200
PLACEHOLDER = "__none__"
QUERIES = ("interest", "exclusion", "positive", "negative")


@dataclass(frozen=True)
class Profile:
    id: int
    kind: str
    interests: tuple[str, ...]
    exclusions: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    selectivity: str = "balanced"
    target_precision: float = 0.82
    threshold: float | None = None
    mode: str = "auto"

    def __post_init__(self) -> None:
        if not self.interests:
            raise ValueError("a profile needs an interest")
        if self.selectivity not in PERCENTILES:
            raise ValueError(f"unknown selectivity: {self.selectivity}")
        if not 0 <= (self.threshold or 0) <= 100:
            raise ValueError("a threshold is between 0 and 100")


@dataclass(frozen=True)
class ProfileUpdate:
    """A partial change of a profile: what is None stays. ``threshold`` counts only with ``threshold_set`` (None: back to automatic)."""

    interests: tuple[str, ...] | None = None
    exclusions: tuple[str, ...] | None = None
    include: tuple[str, ...] | None = None
    never: tuple[str, ...] | None = None
    selectivity: str | None = None
    target_precision: float | None = None
    threshold: float | None = None
    threshold_set: bool = False


def updated(profile: Profile, change: ProfileUpdate) -> Profile:
    """The profile after a change. A new definition makes a learned threshold void: it is automatic again unless the same
    change sets one. A better precision to aim at is no new definition."""
    given = {k: v for k, v in asdict(change).items() if v is not None and k not in ("threshold", "threshold_set")}
    redefined = bool(given.keys() - {"target_precision"})
    if change.threshold_set:
        given |= {"threshold": change.threshold, "mode": "auto" if change.threshold is None else "manual"}
    elif redefined:
        given |= {"threshold": None, "mode": "auto"}
    return replace(profile, **given)


def with_defaults(profiles: list[Profile], interests: dict[str, tuple[str, ...]]) -> list[Profile]:
    """The given profiles and, for each kind of ``interests`` that has none, a balanced automatic one; ordered by kind."""
    have = {p.kind for p in profiles}
    free = max((p.id for p in profiles), default=0) + 1
    missing = [kind for kind in interests if kind not in have]
    return sorted([*profiles, *(Profile(free + i, kind, tuple(interests[kind])) for i, kind in enumerate(missing))], key=lambda p: p.kind)


def term_frequencies(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    runs = docs.select(id_col, F.explode(tx.token_runs(text)).alias("term"))  # rows are filtered in compiled code, array elements are not
    return runs.where(tx.is_term(F.col("term"))).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def raw_weights(tf: DataFrame, documents: Column | int) -> DataFrame:
    """(id, term, tf, df, w): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)."""
    n = F.lit(documents) if isinstance(documents, int) else documents
    return tf.join(document_frequencies(tf), "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1))


def norms(weights: DataFrame, id_col: str) -> DataFrame:
    """(id, norm): the length of each weight vector."""
    return weights.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def tfidf(tf: DataFrame, id_col: str, documents: Column | int) -> DataFrame:
    """(id, term, w): the raw weights scaled to length one (a zero vector stays)."""
    raw = raw_weights(tf, documents)
    return raw.join(norms(raw, id_col), id_col).select(id_col, "term", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def sparse_dot(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(left, right, dot) over shared terms; a join by term, so texts without shared terms don't appear."""
    pairs = left.select(left_id, "term", F.col("w").alias("a")).join(right.select(right_id, "term", F.col("w").alias("b")), "term")
    return pairs.groupBy(left_id, right_id).agg(F.sum(F.col("a") * F.col("b")).alias("dot"))


#: Terms of a broadcast table at most, about as many postings of queries in one, (document, query) pairs that a task sums up, and
#: queries whose sums lie side by side in a row.
HELD, BLOCK, PAIRS, LANES = 1 << 17, 1 << 18, 1_000_000, 16


def sparse_dots(docs: DataFrame, id_col: str, text: Column, documents: int, asked: Column) -> DataFrame:
    """(id, item, dot): the TF-IDF cosine of every document with each of the ``asked`` ones, where they share a term.

    There are about as many pairs as documents times queries, and many shared terms to a pair, so pairs are never shuffled:
    postings of query terms meet by document, and the queries' postings come to them in broadcast blocks of about BLOCK. Term
    counts are stored once. A document's length needs the counts of all its terms: those of frequent terms (at most HELD) are
    broadcast, only postings of rare ones are joined by term."""
    given = docs.select(F.col(id_col).alias("id"), text.alias("t")).repartition("id")
    tf = stored(term_frequencies(given, "id", F.col("t")).withColumn("a", 1 + F.log("tf")).drop("tf"), "tf")
    idf = F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1
    terms = stored(document_frequencies(tf).withColumn("idf", idf), "terms")
    total = terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first().n
    often = F.col("df") * HELD >= total  # the counts add up to the total, so that at most HELD terms can have so many
    known = tf.join(F.broadcast(terms.where(often).select("term", "idf")), "term", "left")
    rare = known.where("idf is null").drop("idf").join(terms.where(~often).select("term", "idf"), "term")
    squares = known.where("idf is not null").unionByName(rare).select("id", F.pow(F.col("a") * F.col("idf"), F.lit(2.0)).alias("s"))
    lengths = stored(squares.groupBy("id").agg(F.sqrt(F.sum("s")).alias("norm")), "norms")

    found = tf.where(asked).join(terms, "term").join(lengths, "id").select(F.col("id").alias("item"), "term", (F.col("a") * F.col("idf") / F.col("norm") * F.col("idf")).alias("b"))
    queries = stored(found, "queries")
    coded = stored(merge.with_ids(queries.select("term").distinct(), 0, ["term"]).withColumnRenamed("id", "code"), "codes")
    ranks = stored(merge.with_ids(queries.select("item").distinct(), 0, ["item"]).withColumn("g", F.floor(F.col("id") / LANES)), "items")
    postings, items = queries.count(), ranks.count()
    few = F.broadcast if coded.count() <= HELD else lambda df: df
    blocks, tasks = max(1, -(-postings // BLOCK)), max(1, -(-documents * items // PAIRS))
    own = tf.join(few(coded), "term").select("id", "code", "a").repartition(tasks, "id")
    own = own.join(lengths.repartition(tasks, "id").hint("shuffle_hash"), "id").select("id", "code", (F.col("a") / F.col("norm")).alias("a"))
    # LANES queries side by side in a row; all weights are above zero, so a sum of zero means no shared term
    lane = lambda k: F.sum(F.when(F.col("id") % LANES == k, F.col("b")).otherwise(0.0)).alias(f"b{k}")
    asking = stored(queries.join(few(coded), "term").join(ranks, "item").groupBy("code", "g").agg(*map(lane, range(LANES))), "asking")
    names = ranks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("items"))
    dots = []
    for k in range(blocks):
        block = F.broadcast(asking.where(F.col("g") % blocks == k))
        sums = own.join(block, "code").groupBy("id", "g").agg(*(F.sum(F.col("a") * F.col(f"b{i}")).alias(f"d{i}") for i in range(LANES)))
        wide = sums.join(F.broadcast(names.where(F.col("g") % blocks == k)), "g")
        each = wide.select("id", "items", F.posexplode(F.array(*(f"d{i}" for i in range(LANES)))).alias("at", "dot")).where("dot > 0")
        dots.append(each.select("id", F.get("items", F.col("at"))["item"].alias("item"), "dot"))
    return functools.reduce(DataFrame.unionByName, dots)


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms).otherwise(0.0)


def percentile(column: str, share: float) -> Column:
    """Nearest rank over the column's values; 50 without values."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})"), F.lit(EMPTY_PERCENTILE))


def source_ratio(feedback: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, ratio): the share of keeps among a source's labelled entries."""
    rows = feedback.select(F.col("entry_id").alias("id"), "label").join(entries.select("id", "source_id"), "id")
    return rows.groupBy("source_id").agg((F.count_if(F.col("label") == "keep") / F.count(F.lit(1))).alias("ratio"))


def query_texts(profile: Profile, positives: str, negatives: str) -> dict[str, str]:
    given = {"interest": " ; ".join(profile.interests), "exclusion": " ; ".join(profile.exclusions), "positive": positives, "negative": negatives}
    return {k: v if v else PLACEHOLDER for k, v in given.items()}


def similarities(entries: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(id, one column for each query): cosines of TF-IDF vectors; the corpus is the entries and the four queries."""
    spark = entries.sparkSession
    docs = entries.select(F.col("id"), F.lit(None).cast("string").alias("q"), F.col("entry_text").alias("t"))
    asked = spark.createDataFrame([(-1 - i, k, texts[k]) for i, k in enumerate(QUERIES)], "id long, q string, t string")
    n = entries.agg((F.count(F.lit(1)) + len(QUERIES)).alias("corpus"))
    tf = term_frequencies(docs.unionByName(asked), "id", F.col("t"))
    weights = tfidf(tf, "id", n.first().corpus)  # one number
    queries = weights.where("id < 0").withColumnRenamed("id", "q")
    dots = sparse_dot(weights.where("id >= 0"), queries, "id", "q")
    wide = dots.groupBy("id").agg(*(F.coalesce(F.sum(F.when(F.col("q") == -1 - i, F.col("dot"))), F.lit(0.0)).alias(k) for i, k in enumerate(QUERIES)))
    return entries.select("id").join(wide, "id", "left").select("id", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in QUERIES))


def scored(entries: DataFrame, profile: Profile, sims: DataFrame, ratios: DataFrame, has: dict[str, bool]) -> DataFrame:
    """Adds the parts (four decimals each, as decimals so that their sum doesn't depend on its order), score and blocked.

    ``has``: which of the query texts aren't empty; others count zero. ``entries`` has id, source_id, title, content, entry_text."""
    d = lambda c: tx.round_to(c, 4).cast("decimal(12,4)")
    rows = entries.join(sims, "id").join(ratios, "source_id", "left").withColumns({"_t": tx.unique_tokens(F.col("title")), "_c": tx.unique_tokens(F.col("content"))})
    rows = rows.withColumn("_lex", tx.lexical(F.col("_t"), F.col("_c"), list(profile.interests)))
    lex = F.col("_lex")
    sim = lambda k: F.col(k) if has.get(k, False) else F.lit(0.0)
    margin = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sim("positive") - sim("negative")))
    included = F.size(tx.matching_phrases(F.col("entry_text"), list(profile.include)))
    parts = {
        "interest_part": d(WEIGHTS["interest"] * F.greatest(F.lit(0.0), F.col("interest"))),
        "lexical_part": d(WEIGHTS["lexical"] * lex["best"]),
        "feedback_part": d(WEIGHTS["feedback"] * margin),
        "source_part": d(WEIGHTS["source"] * F.coalesce("ratio", F.lit(0.0))),
        "exclusion_part": d(WEIGHTS["exclusion"] * F.greatest(F.lit(0.0), sim("exclusion"))),
        "include_part": F.least(F.lit(INCLUDE_MOST), INCLUDE_EACH * included).cast("decimal(12,4)"),
    }
    rows = rows.select("id", "source_id", *(c.alias(k) for k, c in parts.items()), lex["matched"].alias("matched_interests"), (F.size(tx.matching_phrases(F.col("entry_text"), list(profile.never))) > 0).alias("blocked"))
    total = sum((F.col(k) for k in parts), F.lit(0).cast("decimal(12,4)"))
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double"))))


def precision_curve(labelled: DataFrame) -> DataFrame:
    """(score, selected, true_positives, precision) of each distinct score as a lower bound; of (score, keep boolean).

    Scores are summed up first, so the running sums pass over distinct scores only."""
    by = labelled.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("k"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by.select("score", F.sum("n").over(w).alias("selected"), F.sum("k").over(w).alias("true_positives"))
    return rows.withColumn("precision", F.col("true_positives") / F.col("selected"))


def learned_threshold(curve: DataFrame, target: float) -> DataFrame:
    return curve.where((F.col("true_positives") >= TRUE_POSITIVES) & (F.col("precision") >= target)).agg(F.min("score").alias("threshold"))


def choose_threshold(rows: DataFrame, profile: Profile, feedback: DataFrame) -> tuple[float, str]:
    """(threshold, reason). Manual stays; without enough feedback the percentile of scores that aren't blocked; else the
    smallest safe score, at most three points from the current threshold. Only the profile's latest RECENT rows of feedback count."""
    if profile.mode == "manual" and profile.threshold is not None:
        return profile.threshold, "manual"
    own = paging.recent_feedback(feedback, profile.id, RECENT)
    n = own.agg(F.count_if(F.col("label") == "keep").alias("k"), F.count_if(F.col("label") == "discard").alias("d")).first()
    share = PERCENTILES[profile.selectivity]
    cold = rows.where("not blocked").agg(percentile("score", share).alias("t"))
    if n.k < KEEPS or n.d < DISCARDS:
        return cold.first().t, "cold-start"
    current = profile.threshold if profile.threshold is not None else cold.first().t
    labelled = rows.select("id", "score").join(own.select(F.col("entry_id").alias("id"), (F.col("label") == "keep").alias("keep")), "id")
    found = learned_threshold(precision_curve(labelled.select("score", "keep")), profile.target_precision).first().threshold
    if found is None:
        return current, "adaptive-no-safe-threshold"
    return max(current - STEP, min(current + STEP, found)), "adaptive-feedback"


def bucketed(rows: DataFrame, threshold: Column | float) -> DataFrame:
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return rows.withColumn("bucket", F.when(F.col("blocked") | (F.col("score") < t), "filtered").otherwise("relevant"))


@dataclass
class Rescore:
    """One run over a kind's entries: rankings (cached; unpersist them when written), the threshold and how it came about."""

    rankings: DataFrame
    threshold: float
    reason: str
    similarity: str = "tfidf-v1"
    problems: list[str] = field(default_factory=list)


def rescore(entries: DataFrame, profile: Profile, feedback: DataFrame, embed=None) -> Rescore:
    """Scores all entries of the profile's kind. ``embed`` (a function from (entries, texts) to similarities) replaces TF-IDF;
    if it fails, TF-IDF is used and the problem noted. ``entries`` has id, source_id, title, content, source_title, category, content_kind."""
    own = entries.where(F.col("content_kind") == profile.kind)
    own = own.withColumn("entry_text", tx.entry_text(F.col("title"), F.col("content"), F.col("source_title"), F.col("category")))
    recent = paging.recent_feedback(feedback, profile.id, RECENT)
    said = recent.select(F.col("entry_id").alias("id"), "label", "updated_at").join(own.select("id", "entry_text"), "id").orderBy(F.desc("updated_at"), F.desc("id")).collect()
    texts = query_texts(profile, *("\n".join(r.entry_text for r in said if r.label == k) for k in ("keep", "discard")))
    problems, used = [], "tfidf-v1"
    sims = None
    if embed is not None:
        try:
            sims, used = embed(own, texts), "embeddings"
        except Exception as error:  # any provider failure leaves the offline way
            problems.append(str(error))
    if sims is None:
        sims = similarities(own, texts)
    has = {k: v != PLACEHOLDER for k, v in texts.items()}
    rows = scored(own, profile, sims, source_ratio(recent, own), has).persist()  # read by the threshold's queries and the result
    threshold, reason = choose_threshold(rows, profile, feedback)
    ranks = bucketed(rows, threshold).withColumn("profile_id", F.lit(profile.id)).withColumnRenamed("id", "entry_id")
    return Rescore(ranks, threshold, reason, used, problems)
