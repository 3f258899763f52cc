"""Markdown notes of kept entries: text as native column expressions, managed regions merged into what a reader wrote,
and a sink that writes one file per note."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTIES = ("# inkwell:properties:begin", "# inkwell:properties:end")
BODY = ("<!-- inkwell:body:begin -->", "<!-- inkwell:body:end -->")


class Conflict(ValueError):
    pass


def component(value: Column, fallback: Column, most: int = 140) -> Column:
    """Text as one safe part of a path."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*#\[\]\x00-\x1f]', " "), r"\s+", " "), F.lit(" ."))
    cut = F.rtrim(F.substring(clean, 1, most), F.lit(" ."))
    return F.when(F.coalesce(cut, F.lit("")) == "", fallback).otherwise(cut)


def stem(key: Column, id_: Column) -> Column:
    """The note's file name: from the entry's identity, so that a new title doesn't orphan it."""
    return component(F.btrim(F.coalesce(key, F.lit(""))), F.concat(F.lit("entry-"), F.lpad(id_.cast("string"), 6, "0")))


def tag(value: Column) -> Column:
    t = F.btrim(F.regexp_replace(F.replace(F.lower(value), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("unsorted")).otherwise(t)


def quoted(value: Column) -> Column:
    """A double-quoted scalar: backslash, quote and control signs escaped."""
    out = F.coalesce(value, F.lit(""))
    for sign, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return F.concat(F.lit('"'), out, F.lit('"'))


def listed(name: str, values: Column) -> Column:
    items = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit("  - "), quoted(v)))
    return F.when(F.size(items) == 0, F.lit(f"{name}: []")).otherwise(F.concat(F.lit(f"{name}:\n"), F.array_join(items, "\n")))


def label(value: Column) -> Column:
    v = F.btrim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\[\]\n\r]+", " "))
    return F.when(v == "", F.lit("Untitled")).otherwise(v)


def blockquote(value: Column) -> Column:
    return F.array_join(F.transform(F.split(F.coalesce(value, F.lit("")), "\n", -1), lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def external_url(scheme: Column, value: Column, link: Column) -> Column:
    return F.when(scheme == "doi", F.concat(F.lit("https://doi.org/"), value)).when(scheme == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), value)).when(scheme == "s2", F.concat(F.lit("https://www.semanticscholar.org/paper/"), value)).otherwise(F.coalesce(link, F.lit("")))


def properties(n: dict[str, Column]) -> Column:
    line = lambda name, c: F.concat(F.lit(f"{name}: "), quoted(c))
    kind = F.when(F.coalesce(n["content_kind"], F.lit("")) == "", F.lit("paper")).otherwise(n["content_kind"])
    own = F.when(F.coalesce(n["canonical_url"], F.lit("")) != "", n["canonical_url"]).otherwise(n["url"])
    tags = F.array_distinct(F.array(tag(n["category"]), kind))
    return F.concat_ws("\n", F.lit(PROPERTIES[0]), F.concat(F.lit("entry_id: "), n["id"].cast("string")), line("key", stem(n["canonical_key"], n["id"])), line("title", n["title"]), line("source", own), line("source_title", n["source_title"]), line("category", n["category"]), line("content_kind", kind), line("author", n["author"]), line("published_at", n["published_at"]), line("status", n["status"]), listed("keywords", n["keywords"]), listed("tags", tags), F.lit(PROPERTIES[1]))


def body(n: dict[str, Column]) -> Column:
    cited = F.transform(n["references"], lambda r: F.when(r["note"].isNotNull(), F.concat(F.lit("- [["), r["note"], F.lit("|"), label(r["title"]), F.lit("]]"))).when(r["url"] != "", F.concat(F.lit("- ["), label(r["title"]), F.lit("](<"), r["url"], F.lit(">)"))).otherwise(F.concat(F.lit("- "), label(r["title"]))))
    section = F.when(F.size(n["references"]) > 0, F.concat(F.lit("\n## References\n\n"), F.array_join(cited, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(BODY[0] + "\n# "), label(n["title"]), F.lit("\n\n"), blockquote(n["summary"]), F.lit("\n"), section, F.lit(BODY[1]))


def rendered(notes: DataFrame) -> DataFrame:
    """Adds path, properties, body and text; ``notes`` has the entry's columns, keywords and references (title, note, url)."""
    n = {c: F.col(c) for c in notes.columns}
    folder = F.when(F.col("content_kind") == "news", F.lit("News")).otherwise(F.lit("Papers"))
    out = notes.withColumn("path", F.concat(folder, F.lit("/"), stem(n["canonical_key"], n["id"]), F.lit(".md"))).withColumn("properties", properties(n)).withColumn("body", body(n))
    return out.withColumn("text", F.concat(F.lit("---\n"), "properties", F.lit("\n---\n\n"), "body", F.lit("\n\n## Notes\n\n")))


def replaced(document: str, marks: tuple[str, str], block: str) -> str:
    """The document with the one region between the marks replaced; no or several marks are a conflict."""
    start, end = marks
    if document.count(start) != 1 or document.count(end) != 1:
        raise Conflict("management marks are missing or ambiguous")
    a = document.index(start)
    b = document.find(end, a)
    if b < 0:
        raise Conflict("management marks are out of order")
    return document[:a] + block + document[b + len(end) :]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("conflict", T.StringType())]))
def merged(existing: pd.Series, properties_: pd.Series, body_: pd.Series, whole: pd.Series) -> pd.DataFrame:
    """The existing note with its managed regions renewed; the whole new one where none exists; a conflict leaves it alone."""
    rows = []
    for old, p, b, new in zip(existing, properties_, body_, whole):
        try:
            rows.append((new if not old else replaced(replaced(old, PROPERTIES, p), BODY, b), None))
        except Conflict as error:
            rows.append((old, str(error)))
    return pd.DataFrame(rows, columns=["text", "conflict"])


def write(notes: DataFrame, root: str) -> None:
    """One file for each row's path under ``root``: written beside it, then renamed, from the executors."""
    import os
    import uuid

    def put(rows) -> None:
        for r in rows:
            parts = r.path.split("/")
            if r.path.startswith("/") or any(p in ("", ".", "..") for p in parts):
                raise Conflict(f"unsafe path: {r.path}")
            target = os.path.join(root, *parts)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            new = f"{target}.{uuid.uuid4().hex}"
            with open(new, "w", encoding="utf-8") as f:
                f.write(r.text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(new, target)

    notes.select("path", "text").foreachPartition(put)


def needs_sync(entries: DataFrame, exports: DataFrame, folder: Column) -> DataFrame:
    """Kept entries whose export is missing, failed, or under another path."""
    rows = entries.where("status = 'kept'").join(exports.select(F.col("entry_id").alias("id"), "state", "path"), "id", "left")
    return rows.where(F.col("state").isNull() | F.col("state").isin("conflict", "failed", "archived") | (F.col("path") != folder))


def formatted(value: float) -> str:
    """The shortest text that reads back as the number; whole numbers keep .0."""
    return re.sub(r"e([+-])0?(\d)", r"e\g<1>\g<2>", repr(float(value)))
