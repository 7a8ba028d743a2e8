"""Title, links and readable text of HTML pages.

Built on the standard library's tolerant tokenizer. Deviations from a browser-grade
parser concern malformed markup only: unclosed elements end with their parent.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions import tables

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLANKS = re.compile(r"[ \t\x0b\f\r]+")
NEWLINES = re.compile(r"\n{3,}")
SPACE = re.compile(r"\s+")
LEAST_SHARE = 0.25
#: An element that starts ends an open one of the same kind.
SAME_KIND = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Element:
    __slots__ = ("tag", "attributes", "children", "dropped")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.dropped = tag, attributes, [], False

    def walk(self):
        """This element and those below it, in order."""
        yield self
        for c in self.children:
            if isinstance(c, Element):
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.dropped else c.text() for c in self.children)


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        kinds = SAME_KIND.get(tag, set()) | ({"p"} if tag in tables.LINE_TAGS else set())
        if self.open[-1].tag in kinds:
            self.open.pop()
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID and len(self.open) < 500:
            self.open.append(element)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parsed(page: str | None) -> Element:
    builder = Builder()
    try:
        builder.feed(page or "")
        builder.close()
    except (AssertionError, ValueError):
        pass  # what was read so far stands
    return builder.root


def flat(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def title_of(root: Element) -> str:
    return next((e.text().strip() for e in root.walk() if e.tag == "title"), "")


def links_of(root: Element, base: str) -> list[tuple[str, str]]:
    """(absolute URL, anchor text), each URL once, in page order; taken before anything is dropped."""
    out: dict[str, str] = {}
    for e in root.walk():
        href = e.attributes.get("href", "").strip() if e.tag == "a" else ""
        if not href or href.startswith("#") or href.lower().startswith(("mailto:", "javascript:", "data:")):
            continue
        try:
            url = urljoin(base or "", href)
            kind = urlparse(url).scheme
        except ValueError:
            continue
        if kind in ("http", "https"):
            out.setdefault(url, flat(e.text()))
    return list(out.items())


def drop_furniture(root: Element) -> None:
    for e in root.walk():
        names = {e.attributes.get("id", ""), *e.attributes.get("class", "").split()}
        if e.tag in tables.STRIPPED_TAGS or names & tables.FURNITURE:
            e.dropped = True


def visible(root: Element) -> list[Element]:
    """Elements in order, without dropped ones and what is below them."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        if not e.dropped:
            out.append(e)
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]
    return out


def main_element(root: Element) -> Element:
    """The wiki's content if it has one; else the longest article, main or content element; else the body, also if those hold too little."""
    seen = visible(root)
    for e in seen:
        if e.attributes.get("id") == "mw-content-text":
            return e
    first = lambda test: next((e for e in seen if test(e)), None)
    body = first(lambda e: e.tag == "body") or root
    found = [e for e in seen if e.tag == "article"]
    found += [e for e in (first(lambda e: e.tag == "main"), first(lambda e: e.attributes.get("role") == "main"), first(lambda e: e.attributes.get("id") == "content")) if e]
    if not found:
        return body
    size = lambda e: len(flat(e.text()))
    best = max(found, key=size)
    return body if size(body) and size(best) < LEAST_SHARE * size(body) else best


def readable(e: Element) -> str:
    """Text with line ends after block elements and table rows, a space after cells."""
    pieces: list[str] = []

    def add(x: Element) -> None:
        for c in x.children:
            if isinstance(c, str):
                pieces.append(c)
            elif c.tag == "br":
                pieces.append("\n")
            elif not c.dropped:
                add(c)
                pieces.append(" " if c.tag in ("td", "th") else "\n" if c.tag == "tr" or c.tag in tables.LINE_TAGS else "")

    add(e)
    lines = (BLANKS.sub(" ", line).strip() for line in "".join(pieces).split("\n"))
    return NEWLINES.sub("\n\n", "\n".join(lines)).strip()


LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("anchor", T.StringType())])
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(LINK))])


@F.pandas_udf(PAGE)
def extract_page(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    """title, text and links of each page; empty and broken pages give what can be read."""
    rows = []
    for page, base in zip(pages, bases, strict=True):
        root = parsed(page if isinstance(page, str) else "")
        title, links = title_of(root), links_of(root, base if isinstance(base, str) else "")
        drop_furniture(root)
        rows.append((title, readable(main_element(root)), [{"url": u, "anchor": a} for u, a in links]))
    return pd.DataFrame(rows, columns=["title", "text", "links"])


@F.pandas_udf(T.ArrayType(LINK))
def extract_links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    """The links of each page alone: nothing is dropped or rendered."""
    found = (links_of(parsed(page if isinstance(page, str) else ""), base if isinstance(base, str) else "") for page, base in zip(pages, bases, strict=True))
    return pd.Series([[{"url": u, "anchor": a} for u, a in links] for links in found])


def title(page: Column) -> Column:
    """The title alone, without Python: text of the first title element, character references of common kinds decoded."""
    raw = F.trim(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return raw
