"""A small lenient reader of HTML: block elements as a tree, with the pieces of text that stand directly in each."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title textarea template noscript iframe noembed noframes select option button svg math canvas object audio video".split())
CLOSED_BY_SAME = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_MARK = re.compile(r"""<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)


@dataclass
class Element:
    tag: str
    names: str  # values of class, id and role
    parent: int  # -1: none
    depth: int
    chars: int = 0  # of text directly in it
    linked: int = 0  # of these, inside links
    marks: int = 0  # of these, sentence marks
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    elements: list[Element]
    pieces: list[tuple[int, str]]  # (element, decoded text) in page order; a break between blocks is (-1, "")


def read_page(source: str) -> Page:
    """The tree of block elements; element 0 is the page. Inline elements belong to their block, and unclosed ones end with it."""
    elements, pieces = [Element("page", "", -1, 0)], []
    stack: list[tuple[str, int]] = [("page", 0)]  # open blocks and links
    opened: dict[str, list[int]] = {}  # by tag, the places of its open elements in the stack, so that no tag walks the stack
    links = 0
    at, end = 0, len(source)

    def text(upto: int) -> None:
        if upto > at:
            value = html.unescape(source[at:upto]) if "&" in source[at:upto] else source[at:upto]
            owner = stack[-1][1]
            element = elements[owner]
            if value.strip():
                element.chars += len(value)
                element.linked += len(value) if links else 0
                element.marks += sum(map(value.count, ".,!?;:"))
            pieces.append((owner, value))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]].pop()
        pieces.append((-1, ""))

    def innermost(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    for_raw = None
    while at < end:
        if for_raw:
            found = re.compile(rf"</{for_raw}\b[^>]*>?", re.I).search(source, at)
            at = found.end() if found else end
            for_raw = None
            continue
        mark = _MARK.search(source, at)
        if not mark:
            text(end)
            break
        text(mark.start())
        at = mark.end()
        if mark[0] == "<!--":
            close = source.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        tag = (mark[2] or mark[5] or "").lower()
        if not tag:
            continue
        closing, rest = mark[1] or mark[4], mark[3] or mark[6] or ""
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag in VOID:
            pieces.append((-1, "") if tag == "hr" else (stack[-1][1], " "))
            continue
        if closing:
            if opened.get(tag):
                close_to(opened[tag][-1])
                links = 0
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            close_to(len(stack) - 1)
        ended = innermost(CLOSED_BY_SAME.get(tag, ()))
        if tag != "p" and ended > innermost(CONTAINERS.get(tag, ())):
            close_to(ended)
        pieces.append((-1, ""))
        names = " ".join(next(filter(None, m.groups()), "") for m in _NAMED.finditer(rest)) if "=" in rest else ""
        elements.append(Element(tag, names.lower(), stack[-1][1], len(stack)))
        elements[stack[-1][1]].children.append(len(elements) - 1)
        if tag in RAW:
            for_raw = tag
        elif not rest.endswith("/") or tag not in ("svg", "path"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(elements) - 1))
    return Page(elements, pieces)
