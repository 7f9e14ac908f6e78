"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of text blocks, cut at block elements. A linear classifier of a block's tag,
ancestors, class and id words, link share and length gives the cost of calling it content or
boilerplate; the difference is its capacity from the source or to the sink. Blocks next to each
other, and next under one parent, are joined by edges whose capacity halves with every two steps
between them in the tree. A maximum flow separates content (what the source still reaches) from
boilerplate, so a doubtful block goes with its surroundings.

Scripts, styles, templates and comments of the markup are never text. Character references are
decoded, white space in a block becomes one space, blocks are trimmed, and the content blocks are
joined by a newline in page order. ``br`` is white space.

Edge cases: null and empty pages and pages without content give an empty text; unclosed and stray
tags are closed or skipped as browsers roughly do, a tag cut off at the end is dropped; pages are read
whole; repeated rows are read one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ship

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|\Z)", re.S)
ATTRIBUTES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAMES = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe object svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())

#: Costs: what an ancestor's tag, a word of its class, id or role, and a block's own tag speak for.
TAGS = {"article": 4.0, "main": 3.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "button": -9.0, "header": -6.0, "menu": -9.0, "dialog": -9.0, "figcaption": -1.0, "head": -20.0}
WORDS = dict.fromkeys("article content post entry story main body".split(), 1.5) | dict.fromkeys(
    "ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent notice popup modal newsletter subscribe signup share sharing social related recommended "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply disqus login search widget pagination pager toolbar skip".split(), -9.0)
OWN = {"p": 1.0, "h1": 0.5, "h2": 0.5, "h3": 0.5, "blockquote": 0.5, "pre": 0.5, "td": -0.3, "li": -0.3, "th": -0.3}
BIAS, LINKS, LENGTH, NEAR = -1.0, -5.0, 0.5, 2.0


@dataclass
class Element:
    tag: str
    weight: float  # of the tag and its names
    depth: int
    parent: Element | None


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def own_weight(tag: str, attributes: str, inside_article: bool) -> float:
    weight = TAGS.get(tag, 0.0)
    if tag == "header" and inside_article:
        weight = 0.0
    if "=" in attributes and tag not in ("html", "body"):
        words = {w for m in ATTRIBUTES.finditer(attributes) for w in NAMES.findall((m[2] or m[3] or m[4] or "").lower())}
        found = [WORDS[w] for w in words if w in WORDS]
        weight += min(found) if found and min(found) < 0 else max(found, default=0.0)
    return weight


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    top = Element("", 0.0, 0, None)
    open_, links, article, out, at = [top], 0, 0, [], 0
    block: Block | None = None

    def add(text: str) -> None:
        nonlocal block
        if text:
            if block is None:
                if text.isspace():
                    return
                block = Block(next(e for e in reversed(open_) if e.tag not in INLINE))
                out.append(block)
            block.parts.append(text)
            if links:
                block.linked += len(text)

    def close(n: int) -> None:
        nonlocal links, article
        for e in open_[n:]:
            links -= e.tag == "a"
            article -= e.tag == "article"
        del open_[n:]

    while (m := MARKUP.search(page, at)) is not None:
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                block = None
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            add(" ")
        if tag not in INLINE:
            block = None
            for i in range(len(open_) - 1, 0, -1):  # a paragraph ends where a block begins; a list item at the next
                if open_[i].tag == "p" or open_[i].tag == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    close(i)
                    break
                if open_[i].tag not in INLINE:
                    break
        if tag not in VOID and not m[3].endswith("/"):
            links += tag == "a"
            article += tag == "article"
            open_.append(Element(tag, own_weight(tag, m[3], article > 0), open_[-1].depth + 1, open_[-1]))
    add(page[at:])
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def content_cost(block: Block) -> float:
    """How much dearer it is to call the block boilerplate than content."""
    good, bad, e = 0.0, 0.0, block.element
    while e is not None:
        good, bad, e = max(good, e.weight), min(bad, e.weight), e.parent
    size = max(1, sum(map(len, block.parts)))
    return BIAS + good + bad + OWN.get(block.element.tag, 0.0) + LINKS * block.linked / size + LENGTH * min(5.0, len(block.text.split()) ** 0.5)


def steps(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a, n = a.parent, n + 1
        else:
            b, n = b.parent, n + 1
    return n


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, capacity) of neighbours in the page and of neighbours under one parent."""
    out, last = [], {}
    for j, b in enumerate(blocks):
        parent = id(b.element.parent)
        if j:
            out.append((j - 1, j, NEAR * 0.5 ** (steps(blocks[j - 1].element, b.element) / 2)))
        if (i := last.get(parent)) is not None and i < j - 1:
            out.append((i, j, NEAR / 2))
        last[parent] = j
    return out


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; ``cost`` above 0 is capacity from the
    source, below 0 to the sink. Shortest augmenting paths; a node reached by none stays with the sink."""
    n = len(cost)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        room[i][j] = room[i].get(j, 0.0) + c
        room[j][i] = room[j].get(i, 0.0) + c
    left = list(cost)  # what the source or sink can still take
    while True:
        before = {i: i for i in range(n) if left[i] > 1e-9}
        todo, end = deque(before), None
        while todo and end is None:
            i = todo.popleft()
            for j, c in room[i].items():
                if c > 1e-9 and j not in before:
                    before[j] = i
                    if left[j] < -1e-9:
                        end = j
                        break
                    todo.append(j)
        if end is None:
            return [i in before for i in range(n)]
        path = [end]
        while before[path[-1]] != path[-1]:
            path.append(before[path[-1]])
        flow = min(left[path[-1]], -left[end], *(room[j][i] for i, j in zip(path, path[1:], strict=False)))
        left[path[-1]] -= flow
        left[end] += flow
        for i, j in zip(path, path[1:], strict=False):
            room[j][i] -= flow
            room[i][j] += flow


def main_text(page: str) -> tuple[str, int, int]:
    """(text, blocks, content blocks)."""
    blocks = blocks_of(page)
    content = minimum_cut([content_cost(b) for b in blocks], edges_of(blocks))
    kept = [b.text for b, c in zip(blocks, content, strict=True) if c]
    return "\n".join(kept), len(blocks), len(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_content) of each page. One pass, no shuffle."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({id_col: b[id_col], url_col: b[url_col], "text": [t for t, _, _ in found], "n_chars": [len(t) for t, _, _ in found],
                                "n_blocks": [n for _, n, _ in found], "n_content": [n for _, _, n in found]})

    rows = pages.select(id_col, url_col, F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, n_blocks long, n_content long")
