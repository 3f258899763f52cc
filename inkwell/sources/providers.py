"""Scholarly providers' JSON to paper metadata, by native JSON functions; requests are injected callables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import dates, ids
from inkwell.functions.text import collapse_strip

GRAPH = "paperId string, externalIds struct<DOI:string,ArXiv:string>, url string, title string, abstract string, authors array<struct<name:string>>, publicationDate string, year int, fieldsOfStudy array<string>, references array<struct<paperId:string,externalIds:struct<DOI:string,ArXiv:string>,title:string,url:string>>"
REGISTRY = "message struct<title:array<string>,author:array<struct<given:string,family:string>>,abstract:string,published:struct<`date-parts`:array<array<int>>>,subject:array<string>,reference:array<struct<DOI:string,`article-title`:string>>,URL:string>"
REFERENCE = "array<struct<scheme:string,value:string,title:string,url:string>>"


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _reference(doi: Column, arxiv: Column, s2: Column, title: Column, link: Column) -> Column:
    scheme = F.when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").when(_some(s2), "s2").when(_some(link), "url")
    return F.struct(scheme.alias("scheme"), F.coalesce(doi, arxiv, F.when(_some(s2), F.lower(s2)), link).alias("value"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(link, F.lit("")).alias("url"))


def graph_metadata(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Metadata of a citation graph provider's papers; references without any id or address are left out."""
    p = F.col("p")
    refs = F.transform(F.coalesce(p["references"], F.array().cast(_references_type())), lambda r: _reference(ids.doi(r["externalIds"]["DOI"]), ids.arxiv(r["externalIds"]["ArXiv"]), r["paperId"], r["title"], r["url"]))
    return rows.select(id_col, F.from_json(json_col, GRAPH).alias("p")).select(
        id_col, collapse_strip(p["title"]).alias("title"), p["abstract"].alias("abstract"), F.array_join(F.transform(p["authors"], lambda a: a["name"]), ", ").alias("author"),
        dates.normalized(p["publicationDate"], p["year"]).alias("published_at"), ids.doi(p["externalIds"]["DOI"]).alias("doi"), ids.arxiv(p["externalIds"]["ArXiv"]).alias("arxiv"),
        F.lower(p["paperId"]).alias("s2"), p["url"].alias("url"), F.array_distinct(F.coalesce(p["fieldsOfStudy"], F.array().cast("array<string>"))).alias("topics"),
        F.filter(refs, lambda r: r["scheme"].isNotNull()).alias("refs"),
    )


def _references_type() -> str:
    return GRAPH.rpartition("references ")[2]


def registry_metadata(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Metadata of a DOI registry's works: markup stripped from the abstract, dates from their parts, references with a DOI."""
    m = F.col("p")["message"]
    parts = F.get(m["published"]["date-parts"], F.lit(0))
    day = F.make_date(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(1)))
    names = F.transform(m["author"], lambda a: F.btrim(F.concat_ws(" ", a["given"], a["family"])))
    refs = F.transform(F.filter(F.coalesce(m["reference"], F.array().cast("array<struct<DOI:string,`article-title`:string>>")), lambda r: ids.doi(r["DOI"]).isNotNull()), lambda r: F.struct(F.lit("doi").alias("scheme"), ids.doi(r["DOI"]).alias("value"), F.coalesce(r["article-title"], F.lit("")).alias("title"), F.lit("").alias("url")))
    return rows.select(id_col, F.from_json(json_col, REGISTRY).alias("p")).select(
        id_col, collapse_strip(F.get(m["title"], F.lit(0))).alias("title"), collapse_strip(F.regexp_replace(m["abstract"], "<[^>]+>", " ")).alias("abstract"),
        F.array_join(F.filter(names, lambda n: n != ""), ", ").alias("author"), dates.stored(day.cast("timestamp")).alias("published_at"), m["URL"].alias("url"),
        F.array_distinct(F.coalesce(m["subject"], F.array().cast("array<string>"))).alias("topics"), refs.alias("refs"),
    )


def merged(provider: DataFrame, page: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Provider first: the page fills what the provider left blank; lists are joined without repeats."""
    p = page.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    rows = provider.join(p, key, "left")
    types = dict(provider.dtypes)
    out = []
    for c in columns:
        a, b = F.col(c), F.col(f"_p_{c}")
        if types[c].startswith("array"):
            out.append(F.array_distinct(F.concat(F.coalesce(a, F.array().cast(types[c])), F.coalesce(b, F.array().cast(types[c])))).alias(c))
        else:
            out.append(F.when(_some(a), a).otherwise(b).alias(c))
    return rows.select(key, *out)


class Request:
    """A driver-side request with a pause between calls, a cache by key, and repeats after passing faults."""

    def __init__(self, fetch: Callable[[str], str], cache: dict[str, tuple[float, str]] | None = None, pause: float = 1.0, tries: int = 3, max_age: float = 7 * 86400, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.fetch, self.cache, self.pause, self.tries, self.max_age, self.clock, self.sleep = fetch, {} if cache is None else cache, pause, tries, max_age, clock, sleep
        self.last = float("-inf")

    def __call__(self, key: str) -> str:
        held = self.cache.get(key)
        if held and self.clock() - held[0] <= self.max_age:
            return held[1]
        for attempt in range(self.tries):
            wait = self.last + self.pause - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                value = self.fetch(key)
                break
            except (TimeoutError, ConnectionError):
                if attempt + 1 == self.tries:
                    raise
                self.sleep(min(4.0, 2.0**attempt))
        self.cache[key] = (self.clock(), value)
        return value
