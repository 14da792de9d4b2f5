"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is content or not. Its tag, names and text speak for one of the two; a potential between parent and
child says how readily they differ, separately for children that look like boilerplate. Messages go up the tree and
down again (sum-product), which gives each element's probability of being content given the whole page. Weights are fitted to labelled
pages by the likelihood of their labels, whose gradient needs the same messages.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintfleet.llm.dom import INLINE, UNSEEN, VOID, Page, read_page

# fixed values: words in class, id and role values
SIDE_NAMES = ("nav", "menu", "header", "masthead", "topbar", "footer", "sidebar", "aside", "widget", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored",
              "promo", "banner", "cookie", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "login", "search", "form", "share",
              "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "reply", "replies", "disqus", "copyright",
              "legal", "toolbar", "byline", "tags")
MAIN_NAMES = ("article", "content", "main", "post", "entry", "story", "body", "text", "page")
TAGS = ("page", "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "dl", "table", "blockquote", "pre", "figure",
        "figcaption", "nav", "header", "footer", "aside", "form", "fieldset", "address", "dialog")
_TAG = {t: i for i, t in enumerate(TAGS)}
_NAME = re.compile(r"[a-z]+")
_SIDE, _MAIN = frozenset(SIDE_NAMES), frozenset(MAIN_NAMES)
FEATURES = len(TAGS) + 8
EDGES = 8  # (side-like child or not) x parent x child


def _looks(names: str) -> tuple[bool, bool]:
    if not names:
        return False, False
    words = set(_NAME.findall(names))
    return not words.isdisjoint(_SIDE), not words.isdisjoint(_MAIN)


def features(page: Page) -> tuple[list[list[int]], list[list[float]], list[int]]:
    """Per element: the features that are on, their values, and whether the element looks like a side part."""
    on, values, side_like = [], [], []
    for e in page.elements:
        side, main = _looks(e.names)
        side = side and e.tag not in ("html", "body")
        side_like.append(int(side or e.tag in ("nav", "footer", "aside", "form", "header", "dialog")))
        f, v = [len(TAGS)], [1.0]
        if e.tag in _TAG:
            f.append(_TAG[e.tag])
            v.append(1.0)
        if side:
            f.append(len(TAGS) + 1)
            v.append(1.0)
        if main and not side:
            f.append(len(TAGS) + 2)
            v.append(1.0)
        if e.chars:
            density = e.linked / e.chars
            f += [len(TAGS) + 3, len(TAGS) + 4, len(TAGS) + 5, len(TAGS) + 6]
            v += [min(1.0, math.log1p(e.chars) / 7), density, min(1.0, 20 * e.marks / e.chars), 1.0]
        else:
            f.append(len(TAGS) + 7)
            v.append(1.0)
        on.append(f)
        values.append(v)
    return on, values, side_like


def unseen_elements(page: Page) -> list[bool]:
    """True for elements that are never shown as text, and all below them."""
    unseen = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        unseen[i] = e.tag in UNSEEN or (e.parent >= 0 and unseen[e.parent])
    return unseen


def marginals(page: Page, weights: np.ndarray, edges: np.ndarray) -> tuple[list[float], list]:
    """P(content) of each element, and for each child its joint probabilities with its parent.

    Elements come after their parents, so one pass backwards sends all messages up and one forwards sends them down.
    """
    on, values, side = features(page)
    w, e = weights, [math.exp(x) for x in edges]
    n = len(page.elements)
    unary = [math.exp(max(-30.0, min(30.0, sum(w[i] * v for i, v in zip(f, x, strict=True))))) for f, x in zip(on, values, strict=True)]
    below0, below1 = [1.0] * n, [1.0] * n  # product of the children's messages
    up0, up1 = [1.0] * n, [1.0] * n
    parents = [x.parent for x in page.elements]
    unseen = unseen_elements(page)
    for i in range(n - 1, 0, -1):
        if unseen[i]:  # scripts and the like say nothing about what holds them
            continue
        a, b, k = below0[i], below1[i] * unary[i], 4 * side[i]
        m0, m1 = a * e[k] + b * e[k + 1], a * e[k + 2] + b * e[k + 3]
        m0, m1 = m0 / (m0 + m1), m1 / (m0 + m1)
        up0[i], up1[i] = m0, m1
        p = parents[i]
        x, y = below0[p] * m0, below1[p] * m1
        below0[p], below1[p] = x / (x + y), y / (x + y)
    content, joint = [0.0] * n, [None] * n
    down0, down1 = [1.0] * n, [1.0] * n  # what an element hears from above
    for i in range(n):
        if unseen[i]:
            continue
        a, b = below0[i] * down0[i], below1[i] * unary[i] * down1[i]
        content[i] = b / (a + b)
        for c in page.elements[i].children:
            if unseen[c]:
                continue
            # belief without the child's own message
            x, y = a / max(up0[c], 1e-300), b / max(up1[c], 1e-300)
            x, y = x / (x + y), y / (x + y)
            k = 4 * side[c]
            d0, d1 = x * e[k] + y * e[k + 2], x * e[k + 1] + y * e[k + 3]
            down0[c], down1[c] = d0 / (d0 + d1), d1 / (d0 + d1)
            q, r = below0[c], below1[c] * unary[c]
            cells = (x * e[k] * q, x * e[k + 1] * r, y * e[k + 2] * q, y * e[k + 3] * r)
            total = sum(cells)
            joint[c] = tuple(z / total for z in cells)
    return content, joint


def fit(pages: list[tuple[Page, list[int]]], steps: int = 60, rate: float = 0.5, shrink: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials that make the labels likely: gradient ascent, adapted to each weight's past gradients."""
    weights, edges = np.zeros(FEATURES), np.zeros(EDGES)
    past_w, past_e = np.full(FEATURES, 1e-3), np.full(EDGES, 1e-3)
    prepared = [(page, labels, features(page)) for page, labels in pages]
    total = sum(len(labels) for _, labels, _ in prepared)
    for _ in range(steps):
        gw, ge = np.zeros(FEATURES), np.zeros(EDGES)
        for page, labels, (on, values, side) in prepared:
            content, joint = marginals(page, weights, edges)
            for i, label in enumerate(labels):
                if i and joint[i] is None:
                    continue
                miss = label - content[i]
                for f, v in zip(on[i], values[i], strict=True):
                    gw[f] += miss * v
                if i:
                    k = 4 * side[i]
                    ge[k + 2 * labels[page.elements[i].parent] + label] += 1
                    for j, p in enumerate(joint[i]):
                        ge[k + j] -= p
        gw, ge = gw / total - shrink * weights, ge / total - shrink * edges
        past_w += gw * gw
        past_e += ge * ge
        weights += rate * gw / np.sqrt(past_w)
        edges += rate * ge / np.sqrt(past_e)
    return weights, edges


def labelled_pages(number: int = 150, seed: int = 11) -> list[tuple[Page, list[int]]]:
    """Pages of many layouts with known labels. Elements that hold main text carry the mark `data-main`, which is no feature."""
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))

    def sentence() -> str:
        return words(rng.randint(3, 18)).capitalize() + rng.choice("..!?,")

    def side(name: str) -> str:
        links = "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4))}</a></li>' for i in range(rng.randint(2, 7)))
        return {
            "menu": rng.choice([f"<nav><ul>{links}</ul></nav>", f'<div class="{rng.choice(["menu", "nav-bar"])}"><ul>{links}</ul></div>']),
            "header": rng.choice([f"<header><h1>{words(2)}</h1><p>{words(4)}</p></header>", f'<div id="header"><div>{words(3)}</div></div>', f"<header><div>{words(2)}</div><ul>{links}</ul></header>"]),
            "footer": rng.choice([f"<footer><p>&copy; {words(3)}. {sentence()}</p></footer>", f'<div class="footer">{sentence()}</div>', f"<footer>&copy; {words(2)} &middot; {sentence()}</footer>"]),
            "sidebar": rng.choice([f"<aside><h3>{words(2)}</h3><ul>{links}</ul><p>{sentence()}</p></aside>", f'<div class="sidebar"><p>{sentence()}</p><ul>{links}</ul></div>']),
            "ad": f'<div class="{rng.choice(["ad", "advert", "sponsored", "promo"])}">{rng.choice([sentence(), f"<p>{sentence()} {sentence()}</p>"])}</div>',
            "notice": f'<div class="{rng.choice(["cookie-notice", "consent banner", "notice"])}"><p>{sentence()} {sentence()}</p></div>',
            "form": rng.choice([f"<form><p>{words(3)}</p><label>{words(2)}</label><input></form>", f'<div class="newsletter"><form><div>{sentence()}</div><input></form></div>']),
            "comments": f'<{(t := rng.choice(["section", "div"]))} class="comments"><h3>{words(1)}</h3>' + "".join(f'<div class="comment"><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
            "related": f'<div class="related"><h3>{words(2)}</h3><ul>{links}</ul></div>',
        }[name]

    def part() -> str:
        kind = rng.choice(["p"] * 7 + ["h2", "ul", "blockquote", "pre", "table", "figure", "div"])
        text = " ".join(sentence() for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.4:  # main text need not look like sentences
            text = words(rng.choice([1, 2, 5, 20, 80, 300]))
        if rng.random() < 0.2:
            text += f' <a href="/x">{words(2)}</a> {sentence()}'
        if kind in ("ul", "table", "figure"):
            row, cell = {"ul": ("li", ""), "table": ("tr", "td"), "figure": ("figcaption", "")}[kind]
            inner = "".join(f"<{row} data-main>" + (f"<{cell} data-main>{sentence()}</{cell}>" if cell else sentence()) + f"</{row}>" for _ in range(rng.randint(1, 4)))
            return f"<{kind} data-main>{inner}</{kind}>"
        return f"<{kind} data-main>{words(rng.randint(1, 6)) if kind == 'h2' else text}</{kind}>"

    pages = []
    for n in range(number):
        bare = n % 4 == 0  # one block of text without any sentence mark
        holder = rng.choice(["article", "article", "main", 'div class="content"', 'div id="post"', 'div class="entry story"', "section", "div"])
        inner = [f"<h1 data-main>{words(rng.randint(1, 8))}</h1>"] if rng.random() < 0.8 else []
        inner += [f"<p data-main>{words(rng.choice([1, 4, 30, 200]))}</p>"] if bare else [part() for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.35:
            inner.insert(rng.randint(0, len(inner)), side(rng.choice(["ad", "related", "form", "comments"])))
        main = f"<{holder} data-main>{''.join(inner)}</{holder.split()[0]}>"
        if rng.random() < 0.3:
            main = f"<main data-main>{main}</main>"
        if n % 5 == 0:  # nothing but the main text, without a frame
            inner = [f"<p data-main>{words(rng.randint(1, 5))}</p>" for _ in range(rng.randint(1, 3))]
            source = f"<{rng.choice(['article', 'main'])} data-main>{''.join(inner)}"
            pages.append((read_page(source), [1] * (len(inner) + 2)))
            continue
        before = [side(s) for s in ("notice", "header", "menu", "ad", "sidebar") if rng.random() < 0.6]
        after = [side(s) for s in ("comments", "related", "sidebar", "form", "ad", "footer") if rng.random() < 0.5]
        source = f"<html><head><title>{words(3)}</title></head><body data-main>{''.join(before)}{main}{''.join(after)}</body></html>"
        page = read_page(source)
        main_marks = [" data-main" in m for m in _opened(source)]
        pages.append((page, [1, 1, *main_marks[1:]]))  # the page and html stand above the main text
    return pages


def _opened(source: str) -> list[str]:
    """Attribute texts of the elements that the reader makes, in order."""
    return [m[2] for m in re.finditer(r"<([a-z][a-z0-9]*)([^>]*)>", source) if m[1] not in INLINE and m[1] not in VOID]


@cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled_pages())


def main_text(source: str, weights: np.ndarray, edges: np.ndarray, least: float = 0.5) -> str:
    """Decoded text of all content elements: white space inside a block is one space, blocks are joined by one space."""
    page = read_page(source)
    content, _ = marginals(page, weights, edges)
    hidden = unseen_elements(page)
    kept = [" " if owner < 0 else text for owner, text in page.pieces if owner < 0 or (not hidden[owner] and content[owner] >= least)]
    return " ".join("".join(kept).split())


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """The input's columns but the html, and `into`: the page's main text.

    A null or empty page, and one without main text, gives an empty text. Broken markup is read as far as it goes:
    unclosed elements end with what holds them, an unclosed comment or script hides the rest. Rows are read one by one;
    a column named like `into` is replaced.
    """
    model = trained()
    held = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c not in (html_col, into)]

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x or "", *held.value) for x in batch.to_pylist()], pa.string())

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.arrow_udf(texts, "string")(F.col(html_col)).alias(into))
