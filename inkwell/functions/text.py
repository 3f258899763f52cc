"""Text functions as column expressions: whitespace, lines, sentences, summaries, tokens and phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode white space and the information separators, in Java's syntax.
SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Fixed value: characters that end a line (CR LF counts as one).
BREAK = r"(?:\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029])"
# Fixed value: words that scoring ignores.
STOP_WORDS = "a an and are as at be by for from in into is it of on or that the their this to using we with".split()
# Fixed value: what counts as a word in scoring.
TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)?"


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_strip(c: Column) -> Column:
    return F.btrim(collapse(c))


def fields(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; no lines for '', and none after a final line end."""
    parts = F.split(c, BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim_to_word(c: Column, limit: int) -> Column:
    """At most ``limit`` characters: cut at the last space, without signs at the end, with an ellipsis."""
    head = F.substring(c, 1, limit - 1)
    at_word = F.regexp_replace(F.when(head.contains(" "), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head), "[ ,;:-]+$", "")
    shown = F.when(at_word == "", head).otherwise(at_word)
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(shown, f"{SPACE}+$", ""), F.lit("…")))


def truncate(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def sentences(c: Column) -> Column:
    return F.split(c, rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9])", -1)


def first_sentences(parts: Column, most: int, limit: int) -> Column:
    """Sentences joined by a space: the first, then others while at most ``most`` and ``limit`` characters; stops when full."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        over = (acc["n"] > 0) & (F.char_length(longer) > limit)
        took = F.struct(longer.alias("text"), (acc["n"] + 1).alias("n"), ((acc["n"] + 1 == most) | (F.char_length(longer) >= limit)).alias("done"))
        return F.when(acc["done"], acc).when(over, F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(True).alias("done"))).otherwise(took)

    return F.aggregate(parts, start, step, lambda acc: acc["text"])


def summary(title: Column, content: Column, limit: int = 600) -> Column:
    """The extractive summary: up to three leading sentences, from an early 'Abstract:' on; the title, if there is no text."""
    text = collapse_strip(F.coalesce(content, F.lit("")))
    before = F.regexp_extract(text, r"(?is)^(.*?)\babstract:", 1)
    marked = text.rlike(r"(?i)\babstract:") & (F.char_length(before) < 160)
    after = F.regexp_replace(text, rf"(?is)^.*?\babstract:{SPACE}*", "")
    text = F.when(marked & (after != ""), after).otherwise(text)
    text = F.when(text == "", collapse_strip(F.coalesce(title, F.lit("")))).otherwise(text)
    return F.when(text == "", F.lit("No summary is available.")).otherwise(trim_to_word(first_sentences(sentences(text), 3, limit), limit))


def token_runs(c: Column) -> Column:
    """Lower-case words in order, short and stop words among them."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def is_term(t: Column) -> Column:
    return (F.length(t) > 1) & ~t.isin(*STOP_WORDS)


def tokens(c: Column) -> Column:
    """Scoring terms in order: lower case, two characters and more, no stop words."""
    return F.filter(token_runs(c), is_term)


def unique_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def clean_phrases(phrases: Column) -> Column:
    """Trimmed phrases without blanks; of phrases that differ only in case the first stays."""
    trimmed = F.filter(F.transform(phrases, strip), lambda p: p != "")
    keep = lambda acc, p: F.when(F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p)))
    return F.aggregate(trimmed, F.array().cast("array<string>"), keep)


def matching_phrases(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, phrases)).cast("array<string>"), lambda p: low.contains(F.lower(p)))


def entry_text(title: Column, content: Column, source: Column, category: Column) -> Column:
    """What scoring reads: the title twice, the content, the source and its category."""
    return strip(F.concat_ws("\n", title, title, content, F.concat(source, F.lit(" "), category)))


def lexical(in_title: Column, in_content: Column, interests: list[str]) -> Column:
    """struct(best, matched): per interest, the share of its terms found (a title term counts twice as much).

    Takes token columns, made beforehand: inside a lambda an expression would be evaluated for each term."""
    rows = []
    for interest in interests:
        own = unique_tokens(F.lit(interest))
        hit = F.aggregate(own, F.lit(0), lambda acc, t: acc + F.when(F.array_contains(in_title, t), 2).when(F.array_contains(in_content, t), 1).otherwise(0))
        ratio = F.when(F.size(own) > 0, F.least(F.lit(1.0), hit / (2.0 * F.size(own)))).otherwise(0.0)
        rows.append(F.struct(ratio.alias("ratio"), F.lit(interest).alias("interest")))
    found = F.array(*rows)
    return F.struct(
        F.coalesce(F.array_max(F.transform(found, lambda r: r["ratio"])), F.lit(0.0)).alias("best"),
        F.transform(F.filter(found, lambda r: r["ratio"] > 0), lambda r: r["interest"]).alias("matched"),
    )


def round_to(c: Column, places: int) -> Column:
    """Half away from zero on the scaled value, without a negative zero."""
    scale = float(10**places)
    return F.round(c * scale) / scale + F.lit(0.0)
