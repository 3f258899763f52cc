"""Feeds and pages: RSS 2.0, RDF and Atom documents, autodiscovery links, citation metadata. One row in, rows or a struct out.

Parsing runs in vectorised UDFs; a document that can't be read gives an error text instead of failing the job.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import dates, ids, url
from inkwell.sources.markup import plain_text, to_markdown

def _texts(names: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, more.get(n, T.StringType())) for n in names.split()])


ITEM = _texts("guid link title author published markup content")
# Encodings that a document may declare, and media types of feeds.
ENCODINGS = {"utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "ascii", "ascii": "ascii", "iso-8859-1": "latin-1", "latin-1": "latin-1", "latin1": "latin-1", "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
FEED_TYPES = frozenset({"application/rss+xml", "application/atom+xml", "application/rdf+xml"})


class FeedError(ValueError):
    pass


def decoded(document: bytes) -> str:
    """The document's text by its byte order mark or declared encoding; other encodings are refused."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if document.startswith(mark):
            return document.decode(name)
    m = re.match(rb"""\s*<\?xml[^>]*encoding=["']([A-Za-z0-9_.:-]+)["']""", document)
    name = m[1].decode().lower() if m else "utf-8"
    if name not in ENCODINGS:
        raise FeedError(f"unsupported encoding: {name}")
    return document.decode(ENCODINGS[name])


def _name(tag: object) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _all(node: ET.Element, *names: str) -> list[ET.Element]:
    return [c for n in names for c in node if _name(c.tag) == n]


def _first(node: ET.Element, *names: str) -> ET.Element | None:
    """The first child of the first name that has one: names rank before document order."""
    return next(iter(_all(node, *names)), None)


def _text(node: ET.Element | None) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def _markup(node: ET.Element | None) -> str:
    """Inner markup without namespaces, attributes sorted; plain content as it is."""
    if node is None:
        return ""
    if not len(node):
        return (node.text or "").strip()
    out = [html.escape(node.text or "", quote=False)]

    def write(x: ET.Element) -> None:
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in sorted((_name(k), v) for k, v in x.attrib.items()))
        out.append(f"<{_name(x.tag)}{attrs}>{html.escape(x.text or '', quote=False)}")
        for c in x:
            write(c)
            out.append(html.escape(c.tail or "", quote=False))
        out.append(f"</{_name(x.tag)}>")

    for c in node:
        write(c)
        out.append(html.escape(c.tail or "", quote=False))
    return "".join(out)


def _atom_link(item: ET.Element) -> str:
    links = [(x.get("rel", "").lower() or "alternate", x.get("href", "").strip()) for x in _all(item, "link")]
    links = [x for x in links if x[1]]
    return next((h for r, h in links if r == "alternate"), links[0][1] if links else "")


def _rss_link(item: ET.Element) -> str:
    link = _first(item, "link")
    return "" if link is None else link.get("href", "").strip() or _text(link)


# Which children hold what, by kind of feed.
_SHAPE = {
    "atom": {"item": "entry", "date": ("published", "updated"), "guid": ("id",), "body": ("content", "summary")},
    "rss": {"item": "item", "date": ("pubdate", "published", "date", "updated"), "guid": ("guid", "id"), "body": ("encoded", "content", "description", "summary")},
}


def parse_feed(document: bytes) -> list[dict]:
    """Items with raw link and date; raises FeedError for what is no well-formed RSS, RDF or Atom document."""
    try:
        root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", decoded(document)))
    except (ET.ParseError, UnicodeError) as error:
        raise FeedError(str(error)) from error
    kind = {"feed": "atom", "rss": "rss", "rdf": "rss"}.get(_name(root.tag))
    if kind is None:
        raise FeedError(f"unsupported root element: {_name(root.tag)}")
    shape, holder = _SHAPE[kind], root
    if _name(root.tag) == "rss" and (channel := _first(root, "channel")) is not None:
        holder = channel
    out = []
    for item in _all(holder, shape["item"]):
        if kind == "atom":
            names = [_text(_first(a, "name")) or _text(a) for a in _all(item, "author")]
            author, link = ", ".join(n for n in names if n), _atom_link(item)
        else:
            author, link = plain_text(_text(_first(item, "creator", "author"))), _rss_link(item)
        body = _markup(_first(item, *shape["body"]))
        out.append({"guid": _text(_first(item, *shape["guid"])), "link": link, "title": plain_text(_text(_first(item, "title"))) or "Untitled", "author": author, "published": _text(_first(item, *shape["date"])), "markup": body, "content": plain_text(body)})
    return out


@F.pandas_udf(_texts("items error", items=T.ArrayType(ITEM)))
def feed_items(documents: pd.Series) -> pd.DataFrame:
    rows = []
    for d in documents:
        try:
            rows.append((parse_feed(bytes(d)) if d is not None else [], None))
        except (FeedError, RecursionError) as error:
            rows.append(([], str(error)))
    return pd.DataFrame(rows, columns=["items", "error"])


@F.pandas_udf(T.StringType())
def _markdown(markup: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([to_markdown(m, b) for m, b in zip(markup, base)], dtype=object)


def read_items(feeds: DataFrame, source_col: str = "source_id", document_col: str = "document") -> DataFrame:
    """(source_id, position, guid, url, title, author, published_at, content, content_markdown): all items of all feeds.

    Addresses and dates are normalised natively; a feed with a bad address fails as a whole, and gives no items."""
    parsed = feeds.select(F.col(source_col).alias("source_id"), feed_items(F.col(document_col)).alias("f"))
    items = parsed.select("source_id", F.posexplode("f.items").alias("position", "x"))
    items = items.select("source_id", "position", "x.*").withColumn("url", url.canonical_url(F.coalesce("link", F.lit("")))).withColumn("published_at", dates.published_at(F.col("published")))
    bad = items.where("url is null").select("source_id").distinct()
    items = items.join(bad, "source_id", "left_anti")
    guid = F.coalesce(F.nullif("guid", F.lit("")), F.nullif("url", F.lit("")), ids.generated_guid(F.col("title"), F.col("url"), F.col("published_at")))
    return items.select("source_id", "position", guid.alias("guid"), "url", "title", "author", "published_at", "content", _markdown("markup", "url").alias("content_markdown"))


def read_errors(feeds: DataFrame, source_col: str = "source_id", document_col: str = "document") -> DataFrame:
    """(source_id, error) of feeds that can't be read: one bad feed never stops the others."""
    parsed = feeds.select(F.col(source_col).alias("source_id"), feed_items(F.col(document_col)).alias("f"))
    return parsed.where("f.error is not null").select("source_id", F.col("f.error").alias("error"))


class _Heads(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[dict] = []
        self.meta: dict[str, list[str]] = {}
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "link":
            self.links.append(a)
        elif tag == "meta":
            key, content = (a.get("name") or a.get("property") or "").lower(), html.unescape(a.get("content", "")).strip()
            if key and content:
                self.meta.setdefault(key, []).append(content)
        elif tag == "title":
            self.in_title = True

    def handle_endtag(self, tag: str) -> None:
        self.in_title &= tag != "title"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)


def heads(document: str) -> _Heads:
    parser = _Heads()
    parser.feed(document)
    parser.close()
    return parser


def discover(document: str, page: str) -> str:
    """The address of the first feed that the page names (not yet canonical); '' for none or one that is no web address."""
    for a in heads(document).links:
        kind = a.get("type", "").split(";")[0].strip().lower()
        href = a.get("href", "").strip()
        if "alternate" in a.get("rel", "").lower().split() and kind in FEED_TYPES and href:
            try:
                found = urljoin(page, href)
                parts = urlsplit(found)
            except ValueError:
                return ""
            return found if parts.scheme in ("http", "https") and parts.netloc else ""
    return ""


@F.pandas_udf(T.StringType())
def _discovered(documents: pd.Series, pages: pd.Series) -> pd.Series:
    return pd.Series([discover(d or "", p or "") for d, p in zip(documents, pages)], dtype=object)


def discovered_feed(document, page):
    """Column: the canonical address of the page's first feed; '' for none."""
    return F.coalesce(url.canonical_url(_discovered(document, page)), F.lit(""))


def citation(document: str, page: str) -> dict:
    """What a publication page says of its paper in citation_* and similar metadata (identifiers not yet checked)."""
    h = heads(document)
    first = lambda *names: next((h.meta[n][0].strip() for n in names if h.meta.get(n)), "")
    many = lambda *names: [v.strip() for n in names for v in h.meta.get(n, []) if v.strip()]
    own = next((a.get("href", "").strip() for a in reversed(h.links) if a.get("rel", "").lower() == "canonical"), "")
    try:
        canonical = urljoin(page, own) if own else page
        canonical = canonical if urlsplit(canonical).scheme == "https" else page
    except ValueError:
        canonical = page
    title = first("citation_title", "dc.title", "og:title") or " ".join("".join(h.title).split())
    words = [w.strip() for v in many("citation_keywords", "keywords") for w in re.split("[,;]", v) if w.strip()]
    return {
        "title": title, "abstract": first("citation_abstract", "dc.description", "description", "og:description"), "authors": many("citation_author", "dc.creator"),
        "published": first("citation_publication_date", "citation_date", "dc.date", "article:published_time"), "doi": first("citation_doi", "dc.identifier", "prism.doi"),
        "arxiv": first("citation_arxiv_id", "arxiv_id"), "keywords": words, "url": canonical,
    }


@F.pandas_udf(_texts("title abstract authors published doi arxiv keywords url", authors=T.ArrayType(T.StringType()), keywords=T.ArrayType(T.StringType())))
def _citations(documents: pd.Series, pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([citation(d or "", p or "") for d, p in zip(documents, pages)], columns=["title", "abstract", "authors", "published", "doi", "arxiv", "keywords", "url"])


def citation_metadata(pages: DataFrame, id_col: str, document_col: str, page_col: str) -> DataFrame:
    c = pages.select(id_col, _citations(F.col(document_col), F.col(page_col)).alias("c"))
    return c.select(id_col, "c.title", "c.abstract", "c.authors", dates.normalized(F.col("c.published")).alias("published_at"), ids.doi(F.col("c.doi")).alias("doi"), ids.arxiv(F.col("c.arxiv")).alias("arxiv"), "c.keywords", "c.url")


