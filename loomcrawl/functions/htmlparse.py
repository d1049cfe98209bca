"""HTML pages to structured documents.

One Arrow UDF parses a page once and gives all parts of it; the render classifier is
native. The parser builds a tree with the standard library and applies the usual rules
for unclosed elements. Texts join like a browser's: blocks and line breaks as blanks.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcrawl.functions.simhash import simhash_array

SCHEMA = (
    "struct<title:string,description:string,canonical:string,headings:array<struct<level:int,text:string,ordinal:int>>,"
    "outlinks:array<struct<target:string,anchor:string,rel:string,section:string>>,main_text:string,simhash64:bigint,"
    "dom_size:int,indexable:boolean,followable:boolean>"
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_RAW = frozenset(["script", "style"])
_DROP_TAGS = frozenset("header footer nav aside script style noscript template".split())
_DROP_ROLES = frozenset(["navigation", "banner", "complementary"])
_DROP_CLASSES = frozenset(["ad", "ads", "advertisement", "comments"])
_SECTION_TAGS = {"header": "HEADER", "footer": "FOOTER", "nav": "NAV", "aside": "SIDEBAR", "main": "MAIN", "article": "MAIN"}
_SECTION_ROLES = {"banner": "HEADER", "navigation": "NAV", "complementary": "SIDEBAR", "contentinfo": "FOOTER", "main": "MAIN"}
# The marks by which a page is judged to need a browser.
EMPTY_BODY = 5000
SPA_MARKER = r'(?i)<(div|app-root)\s+[^>]*\bid\s*=\s*"(root|app|main|__next)"|<app-root\b|<ng-app\b|data-react'
NOSCRIPT_TEXT = r"(?is)<noscript[^>]*>[^<]{20,}"
_SPACE = re.compile(r"[ \t\n\x0b\f\r\xa0]+")


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))

    def text(self, skip=None) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif skip is None or node is self or not skip(node):
                if node.tag in _RAW and node is not self:
                    continue
                gap = " " if node.tag in _BLOCK or node.tag == "br" else ""
                stack.append(gap)
                stack.extend(reversed(node.children))
                stack.append(gap)
        return _SPACE.sub(" ", "".join(parts)).strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and any(e.tag == "p" for e in self.open[-3:]):
            self._close("p")
        ends = _ENDS.get(tag)
        while ends and self.open[-1].tag in ends:
            self.open.pop()
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in _VOID:
            self.open.pop()

    def _close(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def build_tree(page: str) -> Element:
    builder = _Builder()
    try:
        builder.feed(page)
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


def section_of(node: Element) -> str:
    """H7: by the nearest ancestor or self with a telling tag, or else role."""
    while node is not None:
        if node.tag in _SECTION_TAGS:
            return _SECTION_TAGS[node.tag]
        role = _SECTION_ROLES.get(node.attrs.get("role", "").lower())
        if role:
            return role
        node = node.parent
    return "UNKNOWN"


def _dropped(node: Element) -> bool:
    names = node.attrs.get("class", "").split()
    return node.tag in _DROP_TAGS or node.attrs.get("role") in _DROP_ROLES or any(n in _DROP_CLASSES for n in names) or node.attrs.get("id") == "comments"


def main_text(root: Element) -> str:
    """H8: text of the first article, else main, else role main, else body, without page furniture."""
    nodes = list(root.walk())
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "body"):
        found = next((n for n in nodes if test(n)), None)
        if found is not None:
            return found.text(skip=_dropped)
    return root.text(skip=lambda n: _dropped(n) or n.tag in ("head", "title"))


def absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


def parse_page(url: str, page: str) -> dict:
    """All parts of one page; links and the canonical url are absolute but not yet canonical."""
    root = build_tree(page)
    nodes = list(root.walk())
    base = next((absolute(url, n.attrs["href"]) for n in nodes if n.tag == "base" and n.attrs.get("href")), url)
    robots = " ".join(n.attrs.get("content", "").lower() for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower() == "robots")
    canonical = next((n.attrs.get("href") for n in nodes if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical" and n.attrs.get("href")), None)
    title = next((n.text() for n in nodes if n.tag == "title"), "")
    description = next((n.attrs.get("content", "") for n in nodes if n.tag == "meta" and n.attrs.get("name", "").lower() == "description"), "")
    heads = [(int(n.tag[1]), n.text()) for n in nodes if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456"]
    headings = [{"level": level, "text": text, "ordinal": k} for k, (level, text) in enumerate(x for x in heads if x[1])]
    followable = "nofollow" not in robots
    outlinks = []
    if followable:
        for n in nodes:
            if n.tag == "a" and "href" in n.attrs:
                outlinks.append({"target": absolute(base, n.attrs["href"]), "anchor": n.text(), "rel": n.attrs.get("rel", ""), "section": section_of(n)})
    return {
        "title": title,
        "description": description,
        "canonical": absolute(base, canonical) if canonical else None,
        "headings": headings,
        "outlinks": outlinks,
        "main_text": main_text(root),
        "dom_size": len(page.encode("utf-16-le", "surrogatepass")) // 2,
        "indexable": "noindex" not in robots,
        "followable": followable,
    }


def decode(body: bytes | None, content_type: str | None) -> str:
    if not body:
        return ""
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    for name in ([found[1]] if found else []) + ["utf-8"]:
        try:
            return bytes(body).decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return bytes(body).decode("cp1252", "replace")


def parse_html(url: Column, body: Column, content_type: Column) -> Column:
    """H1: struct of all parts of a page; NULL for a NULL body."""

    @F.pandas_udf(SCHEMA)
    def run(urls: pd.Series, bodies: pd.Series, types: pd.Series) -> pd.DataFrame:
        rows = [parse_page(u or "", decode(b, t)) for u, b, t in zip(urls, bodies, types)]
        frame = pd.DataFrame(rows, columns=["title", "description", "canonical", "headings", "outlinks", "main_text", "dom_size", "indexable", "followable"])
        frame.insert(6, "simhash64", simhash_array([r["main_text"] for r in rows]).view(np.int64) if rows else [])
        return frame

    return F.when(body.isNotNull(), run(url, body, content_type))


#: Encodings of one byte a character, for which sizes and ASCII marks are those of ISO-8859-1.
SINGLE_BYTE = r"(?i)charset\s*=\s*[\"']?(?:iso-8859-|latin-?1|windows-125|cp125|us-ascii)"


def page_text(body: Column, content_type: Column) -> Column:
    """A body as text by the charset of its content type, without leaving the JVM.

    Bodies of other than single-byte encodings are read as UTF-8, each broken sequence as
    one replacement character.
    """
    single = F.coalesce(content_type.rlike(SINGLE_BYTE), F.lit(False))
    return F.when(single, F.decode(body, "ISO-8859-1")).otherwise(F.make_valid_utf8(body.cast("string")))


def render_reason(status: Column, page: Column) -> Column:
    """Why a page needs a browser, NULL for none. Native throughout."""
    low = F.lower(page)
    start = F.locate("<body", low)
    after = F.call_function("locate", F.lit(">"), low, start)
    tail = F.locate(">ydob/<", F.reverse(low))
    close = F.length(low) - tail - 5
    size = F.when((start > 0) & (after > 0) & (tail > 0) & (close >= after), close - after).otherwise(-1)
    return (
        F.when(~status.between(200, 299) | page.isNull(), F.lit(None).cast("string"))
        .when((size >= 0) & (size < EMPTY_BODY), "EMPTY_BODY")
        .when(page.rlike(SPA_MARKER), "SPA_FRAMEWORK_DETECTED")
        .when(page.rlike(NOSCRIPT_TEXT), "CLASSIFIER_OTHER")
    )
