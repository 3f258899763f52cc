"""HTML to plain text and to Markdown: a tree in a vectorised UDF, since trees have no Spark type."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups of tags.
BLOCKS = frozenset("article aside dd details div dl dt figcaption figure footer header main nav p section summary".split())
DROPPED = frozenset("embed iframe object script style svg template".split())
EMPTY = frozenset("br hr img input link meta".split())
KNOWN = (
    "a article aside b blockquote br code dd del details div dl dt em embed figcaption figure footer h[1-6] header hr i iframe img kbd li main mark nav object ol"
    " p pre q s script section small span strike strong style sub summary sup svg table tbody td template tfoot th thead time tr u ul"
).split()
BREAKS = frozenset("div h1 h2 h3 li p tr".split())
# Fixed value: an open tag that a new one closes, and the tags it doesn't look beyond.
CLOSES = {
    "li": ({"li"}, {"ol", "ul"}),
    "p": ({"p"}, BLOCKS - {"p"}),
    "tr": ({"tr"}, {"table", "tbody", "tfoot", "thead"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
}
_ANY_TAG = re.compile(rf"</?(?:{'|'.join(KNOWN)})\b", re.I | re.A)
_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
_LINKS = ("http", "https", "mailto")
_SAFE = "/:#?[]@!$&'()*+,;=%"


def collapse(s: str) -> str:
    return re.sub(r"\s+", " ", s)


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.items = tag, attrs, []  # items: str or Node

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.items)
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        mine, stops = CLOSES.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in stops:
                break
            if self.open[depth].tag in mine:
                del self.open[depth:]
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and len(self.open) > 1:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        if data:
            self.open[-1].items.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.open[0]


def safe_link(value: str, base: str) -> str:
    """The address quoted, or '' if it is no web or mail link and no rooted, local or dotted reference."""
    value = value.strip()
    if not value:
        return ""
    try:
        value = urljoin(base, value) if base else value
        scheme = urlsplit(value).scheme
    except ValueError:
        return ""
    if scheme not in _LINKS and (scheme or not value.startswith(("/", "#", "./", "../"))):
        return ""
    return quote(value, safe=_SAFE)


def _label(value: str, otherwise: str) -> str:
    return (collapse(value).strip() or otherwise).replace("[", "\\[").replace("]", "\\]")


class _Writer:
    """Markdown of a tree; each kind of element is one method."""

    def __init__(self, base: str) -> None:
        self.base = base

    def inside(self, node: Node) -> str:
        return "".join(collapse(x) if isinstance(x, str) else self.write(x) for x in node.items)

    def write(self, node: Node) -> str:
        tag = node.tag
        if tag in DROPPED:
            return ""
        if tag in ("pre", "code", "img", "table", "ul", "ol", "br", "hr"):
            return {"pre": self.pre, "code": self.code, "img": self.image, "table": self.table, "ul": self.items, "ol": self.items, "br": lambda _: "\n", "hr": lambda _: "\n\n---\n\n"}[tag](node)
        body = self.inside(node)
        bare = body.strip()
        if tag in BLOCKS:
            return f"\n\n{bare}\n\n" if bare else ""
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {bare}\n\n"
        if tag in _WRAP:
            return f"{_WRAP[tag]}{bare}{_WRAP[tag]}" if bare else ""
        if tag == "a":
            href = safe_link(node.attrs.get("href", ""), self.base)
            shown = _label(body, href or "link")
            return f"[{shown}](<{href}>)" if href else shown
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {line}" if line else ">" for line in bare.splitlines()) + "\n\n"
        return body

    def pre(self, node: Node) -> str:
        value = node.text().strip("\n")
        if not value:
            return ""
        first = next((x for x in node.items if isinstance(x, Node)), None)
        classes = first.attrs.get("class", "").split() if first is not None and first.tag == "code" else []
        language = next((c.removeprefix("language-") for c in classes if c.startswith("language-")), "")
        fence = "````" if "```" in value else "```"
        return f"\n\n{fence}{language}\n{value}\n{fence}\n\n"

    def code(self, node: Node) -> str:
        value = collapse(node.text()).strip()
        if not value:
            return ""
        tick = "``" if "`" in value else "`"
        gap = " " if value.startswith("`") or value.endswith("`") else ""
        return f"{tick}{gap}{value}{gap}{tick}"

    def image(self, node: Node) -> str:
        source = safe_link(node.attrs.get("src", ""), self.base)
        return f"![{_label(node.attrs.get('alt', ''), 'image')}](<{source}>)" if source else ""

    def table(self, node: Node) -> str:
        rows: list[tuple[bool, list[str]]] = []
        todo = [node]
        while todo:
            x = todo.pop()
            if x.tag == "tr":
                cells = [c for c in x.items if isinstance(c, Node) and c.tag in ("td", "th")]
                if cells:
                    rows.append((any(c.tag == "th" for c in cells), [collapse(self.write(c).strip()).replace("|", "\\|") for c in cells]))
            else:
                todo += [c for c in reversed(x.items) if isinstance(c, Node)]
        if not rows:
            return ""
        wide = max(len(cells) for _, cells in rows)
        lines = [cells + [""] * (wide - len(cells)) for _, cells in rows]
        head = lines.pop(next((i for i, (is_head, _) in enumerate(rows) if is_head), 0))
        return "\n\n" + "\n".join(f"| {' | '.join(cells)} |" for cells in (head, ["---"] * wide, *lines)) + "\n\n"

    def items(self, node: Node) -> str:
        return "\n\n" + self.list(node, 0) + "\n\n"

    def list(self, node: Node, depth: int) -> str:
        lines = []
        for number, item in enumerate((x for x in node.items if isinstance(x, Node) and x.tag == "li"), 1):
            own, below = [], []
            for x in item.items:
                if isinstance(x, Node) and x.tag in ("ul", "ol"):
                    below.append(x)
                else:
                    own.append(x if isinstance(x, str) else self.write(x))
            body = re.sub(r"\s*\n\s*", " ", "".join(own)).strip()
            mark = f"{number}." if node.tag == "ol" else "-"
            lines += [f"{'  ' * depth}{mark} {body}".rstrip(" \t"), *(self.list(x, depth + 1) for x in below)]
        return "\n".join(line for line in lines if line)


def to_markdown(html: str | None, base: str | None = "") -> str:
    """Markdown of feed markup; text without a known tag passes unchanged but for its ends."""
    value = (html or "").replace("\r\n", "\n").replace("\r", "\n")
    if not _ANY_TAG.search(value):
        return value.strip()
    root = tree(value)
    try:
        out = _Writer(base or "").inside(root)
    except RecursionError:
        return fallback_text(root)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip()


def fallback_text(root: Node) -> str:
    """The text of a tree without dropped elements, on one line."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in DROPPED:
            if x.tag in BLOCKS or x.tag in ("br", "li"):
                out.append("\n")
            todo += reversed(x.items)
    return collapse("".join(out)).strip()


class _Pieces(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS or tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data)


def plain_text(html: str | None) -> str:
    """One line of text: pieces between tags parted by spaces; a value without < and > is only collapsed."""
    value = html or ""
    if "<" in value and ">" in value:
        parser = _Pieces()
        parser.feed(value)
        parser.close()
        value = " ".join(parser.out)
    return collapse(value).strip()


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(plain_text)


@F.pandas_udf(T.StringType())
def html_markdown(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([to_markdown(h, b) for h, b in zip(html, base)], dtype=object)
