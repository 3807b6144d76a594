"""HTML: expressions for flat rules over raw markup, and Arrow UDFs where a tree is needed.

The tree is the standard library's parser with these rules: void elements have no
content; script and style hold raw text; the start of a block closes an open ``p``;
an end tag closes what is open inside its element, and one without a start is ignored.
A reference (``&amp;``) ends with its semicolon; without one, or of no known name, it is text.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element names.
FRAGMENT_BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li")
TEXT_BLOCKS = FRAGMENT_BLOCKS + ("div", "section", "article", "tr", "table", "ul", "ol")
VISIBLE_BLOCKS = FRAGMENT_BLOCKS + ("div", "section", "article", "br", "tr", "td", "th", "pre")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HIDDEN = ("head", "script", "style")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CLOSES_P = set(TEXT_BLOCKS) | {"pre", "hr", "dl", "form", "header", "footer", "nav"}


# -- expressions ---------------------------------------------------------------

#: How a tag's name and the start of a block look in raw markup.
TAG, BLOCK = r"</?([A-Za-z][A-Za-z0-9]*)\b", r"<(p|h1|h2|h3|h4|h5|h6|blockquote|li)\b"


def strip_tags(html: Column) -> Column:
    """Each tag as a blank; entities stay."""
    return F.regexp_replace(html, r"<[^>]+>", " ")


def tag_names(html: Column) -> Column:
    """Distinct lower-cased names of tags, but for html, head and body."""
    found = F.regexp_extract_all(html, F.lit(TAG), 1)
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(F.lit("html"), F.lit("head"), F.lit("body")))


def count_blocks(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)" + BLOCK))


def body_markup(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)


def tag_names_of(html: str) -> set[str]:
    """``tag_names`` of one value."""
    return {x.lower() for x in re.findall(TAG, html, re.A)} - {"html", "head", "body"}


def count_blocks_of(html: str) -> int:
    """``count_blocks`` of one value."""
    return len(re.findall(BLOCK, html, re.A | re.I))


# -- the tree ------------------------------------------------------------------

class Node:
    __slots__ = ("name", "start", "inner", "inner_end", "end", "children", "text")

    def __init__(self, name: str, start: int, inner: int, text: str | None = None):
        self.name, self.start, self.inner, self.inner_end, self.end, self.text = name, start, inner, inner, inner, text
        self.children: list[Node] = []


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.html = html
        self.lines = [0]
        for i, c in enumerate(html):
            if c == "\n":
                self.lines.append(i + 1)
        self.root = Node("", 0, 0)
        self.open = [self.root]
        self.feed(html.replace("&", "\x1a"))  # references are no matter of the parser: texts are taken from ``html`` by their places
        self.close()
        while len(self.open) > 1:
            self._shut(len(html), len(html))
        self.root.inner_end = self.root.end = len(html)

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, inner_end: int, end: int) -> None:
        node = self.open.pop()
        node.inner_end, node.end = inner_end, end

    def handle_starttag(self, tag, attrs):
        at = self._here()
        if tag in CLOSES_P and self.open[-1].name == "p":
            self._shut(at, at)
        if tag == "li" and self.open[-1].name == "li":
            self._shut(at, at)
        node = Node(tag, at, at + len(self.get_starttag_text() or ""))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        at = self._here()
        self.open[-1].children.append(Node(tag, at, at + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag):
        if all(n.name != tag for n in self.open[1:]):
            return
        at = self._here()
        end = self.html.find(">", at) + 1 or len(self.html)
        while self.open[-1].name != tag:
            self._shut(at, at)
        self._shut(at, end)

    def handle_data(self, data):
        at = self._here()
        self.open[-1].children.append(Node("#text", at, at, self.html[at : at + len(data)]))


_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def decoded(text: str) -> str:
    """``text`` with its references resolved."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], text)


def parse(html: str) -> Node:
    return _Tree(html).root


def walk(node: Node):
    """Every node below ``node``, in order, at any depth."""
    left = node.children[::-1]
    while left:
        n = left.pop()
        yield n
        left.extend(reversed(n.children))


def edges(node: Node, shut: tuple[str, ...]):
    """(node, ended) below ``node`` in order, at any depth: where each one starts and where it ends; those named in ``shut`` are not entered."""
    left = [(c, False) for c in reversed(node.children)]
    while left:
        n, ended = left.pop()
        yield n, ended
        if n.text is None and not ended:
            left.append((n, True))
            if n.name not in shut:
                left.extend((c, False) for c in reversed(n.children))


def _body(root: Node) -> Node | None:
    return next((n for n in walk(root) if n.name == "body"), None)


def plain_text_of(html: str) -> str:
    """Readable text: a newline after each block and for each break, but never two in a row from markup nor one at the start."""
    root = parse(html)
    out: list[str] = []

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for n, ended in edges(_body(root) or root, HIDDEN):
        if n.text is not None:
            if n.text:
                out.append(decoded(n.text))
        elif ended and (n.name == "br" or n.name in TEXT_BLOCKS):
            line()
    return "".join(out)


def body_inner_of(html: str) -> str:
    body = _body(parse(html))
    return html[body.inner : body.inner_end] if body else ""


def block_fragments_of(html: str) -> list[str]:
    """The outermost blocks' markup in order; if there is none, the whole body unless it is blank."""
    root = parse(html)
    body = _body(root) or root
    out = [html[n.start : n.end] for n, ended in edges(body, FRAGMENT_BLOCKS) if ended and n.name in FRAGMENT_BLOCKS]
    whole = html[body.inner : body.inner_end]
    return out or ([whole] if whole.strip() else [])


#: White space as in the queries' SQL; str.split() would take control signs too.
_SPACE = re.compile(r"[\t\n\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+")


def first_heading_of(html: str) -> str | None:
    for n in walk(parse(html)):
        if n.name in HEADINGS:
            text = _SPACE.sub(" ", decoded("".join(c.text for c in walk(n) if c.text is not None))).strip(" ")
            if text:
                return text
    return None


def visible_text_of(html: str) -> str:
    """Text for validation: a newline before and after each block."""
    out: list[str] = []
    for n, _ in edges(parse(html), HIDDEN):
        if n.text is not None:
            out.append(decoded(n.text))
        elif n.name in VISIBLE_BLOCKS:
            out.append("\n")
    return "".join(out)


def replace_body_of(html: str, inner: str) -> str:
    """``html`` with another body; an XML declaration is added where there is none."""
    body = _body(parse(html))
    if body is None:
        raise ValueError("the document has no body")
    out = html[: body.inner] + inner + html[body.inner_end :]
    return out if out.lstrip().startswith("<?xml") else '<?xml version="1.0" encoding="utf-8"?>\n' + out


def _udf(fn, kind: T.DataType):
    @F.pandas_udf(kind)
    def apply(x: pd.Series) -> pd.Series:
        return x.map(fn, na_action="ignore")

    return apply


plain_text = _udf(plain_text_of, T.StringType())
body_inner = _udf(body_inner_of, T.StringType())
block_fragments = _udf(block_fragments_of, T.ArrayType(T.StringType()))
first_heading = _udf(first_heading_of, T.StringType())
visible_text = _udf(visible_text_of, T.StringType())


@F.pandas_udf(T.StringType())
def replace_body(html: pd.Series, inner: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or b is None else replace_body_of(h, b) for h, b in zip(html, inner)])

