"""A small, forgiving HTML reader: the tree of block elements with their own text.

Whole bodies are read. Inline elements belong to the block around them; scripts, styles
and the head are left out; unclosed elements end where their parent does or where an
element starts that cannot be inside them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_CLASS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup svg time tt u var wbr button select option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template head title iframe object textarea".split())
_ENDS = {
    "li": frozenset(["li"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tr": frozenset(["tr", "td", "th"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
}
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """A block element, or a later run of text in one (``tag`` is then that of the element)."""

    tag: str
    names: str
    parent: int
    depth: int
    text: str = ""
    linked: int = 0
    parts: list = field(default_factory=list)


def decode(body: bytes | None, content_type: str | None) -> str:
    """Text of a body by the charset of its content type, UTF-8 where that fails."""
    if not body:
        return ""
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    for name in ([found[1]] if found else []) + ["utf-8"]:
        try:
            return bytes(body).decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return bytes(body).decode("cp1252", "replace")


def read(page: str) -> list[Node]:
    """Nodes in document order; node 0 is the root. Parents come before their children."""
    nodes = [Node("body", "", -1, 0)]
    stack = [0]
    target, links, skip, at, size = 0, 0, None, 0, len(page)

    def close(upto: int) -> None:
        nonlocal target
        del stack[upto:]
        target = -1

    def text(run: str) -> None:
        nonlocal target
        if not run or run.isspace():
            return
        if target < 0:
            block = stack[-1]
            if not nodes[block].parts and block:
                target = block
            else:
                nodes.append(Node(nodes[block].tag, nodes[block].names, block, nodes[block].depth + 1))
                target = len(nodes) - 1
        elif target == 0:
            nodes.append(Node("body", "", 0, 1))
            target = len(nodes) - 1
        nodes[target].parts.append(run)
        if links:
            nodes[target].linked += len(run.strip())

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            if skip is None:
                text(page[at:])
            break
        if skip is None and m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if skip is not None:
            if closing and tag == skip:
                skip = None
            continue
        if tag in _SKIP:
            if not closing:
                skip = tag
                if skip not in ("head",) and page.find("</" + tag, at) < 0 and page.find("</" + tag.upper(), at) < 0:
                    skip = None
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                text(" ")
                if target >= 0 and nodes[target].parts:
                    nodes[target].parts.append("\n")
            continue
        if tag in ("html", "body"):
            if tag == "body" and not closing:
                nodes[0].names = _names(m[3])
            continue
        links = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
            else:
                target = -1
            continue
        if nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        ends = _ENDS.get(tag)
        while ends and len(stack) > 1 and nodes[stack[-1]].tag in ends:
            close(len(stack) - 1)
        parent = stack[-1]
        nodes.append(Node(tag, _names(m[3]), parent, nodes[parent].depth + 1))
        target = -1
        if tag not in _VOID:
            stack.append(len(nodes) - 1)
    for node in nodes:
        if node.parts:
            node.text = _SPACE.sub(" ", html.unescape("".join(node.parts))).strip()
    return nodes


def _names(attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return ""
    return " ".join((a or b or c).lower() for _, a, b, c in _CLASS.findall(attributes))
