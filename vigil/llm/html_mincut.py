"""Main text of a page by a minimum cut between content and boilerplate.

The page is read as a sequence of text blocks. A logistic classifier of block features gives each block a cost of being
content and one of being boilerplate: the capacities of its edges to the two terminals. Blocks next to each other and
blocks that share DOM ancestors are joined by smoothness edges. The minimum cut (max-flow) labels all blocks of a page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The start of a comment, a declaration (or what browsers read as one), or a tag.
START = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: The rest of a tag; quotes count after an equals sign only. Possessive, so a failure costs one pass.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
UNQUOTED = re.compile(r"([^>]*)>")
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop|hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?<![\w-])hidden(?![\w-])", re.I)
SPACE = re.compile(r"\s+")
#: Elements whose text is never shown as running text.
SILENT = frozenset("script style noscript template head title svg math iframe object select option textarea button canvas audio video datalist".split())
#: Elements with raw text: no tag inside counts but their own end.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others start a new block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that an opening tag of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that close an open paragraph.
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: What elements and their names say about the text inside, in the log-odds of content.
BY_TAG = {"article": 4.0, "main": 2.5, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "header": -6.0, "dialog": -12.0, "menu": -12.0, "address": -4.0}
#: ``header`` inside an article is that of the article.
BAD_NAME = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|banner|breadcrumb\w*|byline|comments?|commentlist|consent|cookies?|copyright|disqus|disclaimer|dropdown|footer|gdpr|masthead"
    r"|menus?|modal|nav\w*|newsletter|notices?|pager|pagination|popup|privacy|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar\w*|side|social|sponsor\w*"
    r"|subscribe|tags|toolbar|topbar|warning|widget\w*)(?![a-z])",
    re.I,
)
GOOD_NAME = re.compile(r"(?<![a-z])(?:article\w*|body-?text|content|entry|hentry|main|post|story|text)(?![a-z])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements around the content, whose names tell of the layout (``no-sidebar``) and not of what is inside.
WHOLE = ("html", "body", "main", "article")
NAMED_BAD, NAMED_GOOD, IS_HIDDEN = -12.0, 2.0, -16.0
#: Phrases of boilerplate at the start of a block.
PHRASE = re.compile(r"^\W*(?:©|\(c\)|copyright\b|all rights reserved|we use cookies|accept (?:all )?cookies|advertisement\b|sponsored\b|share (?:this|on)\b|follow us\b|sign up\b|subscribe\b|log ?in\b|read more\b|related (?:posts|articles)\b|leave a (?:reply|comment)\b|skip to\b|home ?[|»>])", re.I)

#: Classifier: bias, share of text in links, log of words, ends like a sentence, boilerplate phrase.
BIAS, LINKED, LENGTH, SENTENCE, PHRASED = -1.2, -5.0, 0.55, 0.6, -3.0
#: Smoothness: between neighbours in page order, and more for each DOM ancestor that only some pairs share.
NEXT_TO, SHARED = 0.5, 0.4
FARTHEST = 40.0


@dataclass
class Block:
    text: str
    words: int
    linked: float
    prior: float
    tag: str
    depth: int  # block elements around it
    parent: int  # the one around the innermost
    shared: int  # block elements around this and the block before


@dataclass(frozen=True)
class Open:
    """An open element, with what it and those around it say."""

    tag: str
    prior: float
    silent: bool
    depth: int
    block: int
    parent: int
    block_tag: str


def _node_prior(tag: str, attributes: str, in_article: bool) -> float:
    prior = BY_TAG.get(tag, 0.0)
    if tag == "header" and in_article:
        prior = 0.0
    for m in ATTRIBUTE.finditer(attributes):
        value = (m[1] or "hidden").strip("\"'")
        key = m[0][:6].lower()
        if key.startswith("hidden") or HIDDEN.search(value):
            prior += IS_HIDDEN
        elif not key.startswith("style"):
            name = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
            if BAD_NAME.search(name) and tag not in WHOLE:
                prior += NAMED_BAD
            elif GOOD_NAME.search(name):
                prior += NAMED_GOOD
    return prior


def _closes_itself(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not part of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = max(attributes.rfind(c) for c in " \t\n\r\f\"'")
    return "=" not in attributes[last + 1 :]


def read_blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order, with what their ancestors say about them, in time linear in the page.

    After a tag that no > ends but one in quotes, quotes no longer count on the page.
    """
    blocks: list[Block] = []
    outside = Open("", 0.0, False, 0, 0, 0, "")
    stack: list[Open] = [outside]
    opened: Counter = Counter()
    text: list[str] = []
    linked, number, low, at, end, rest = 0, 0, 0, 0, len(page), REST

    def flush() -> None:
        nonlocal linked, low
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                top = stack[-1]
                blocks.append(Block(whole, whole.count(" ") + 1, min(1.0, linked / len(whole)), top.prior, top.block_tag, top.depth, top.parent, low))
                low = top.depth
            linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part and not stack[-1].silent:
            text.append(part)
            if opened["a"]:
                linked += len(SPACE.sub(" ", part).strip())

    def close(n: int) -> None:
        nonlocal low
        for x in stack[n:]:
            opened[x.tag] -= 1
        del stack[n:]
        low = min(low, stack[-1].depth)

    while at < end:
        m = START.search(page, at)
        say(page[at : m.start() if m else end])
        if m is None:
            break
        if m[1] or m[2]:
            mark = "-->" if m[1] else ">"
            found = page.find(mark, m.end())
            at = found + len(mark) if found >= 0 else end
            continue
        r = rest.match(page, m.end())
        if r is None:
            rest = UNQUOTED
            r = rest.match(page, m.end())
        if r is None:
            break  # a tag that the page's end cuts off
        at, tag, attributes = r.end(), m[4].lower(), r[1]
        if tag not in INLINE:
            flush()
        if m[3]:
            if opened[tag]:
                n = len(stack) - 1
                while stack[n].tag != tag:
                    n -= 1
                close(n)
            continue
        if tag in BREAKS_P and any(x.tag == "p" for x in stack[-8:]):
            i = max(k for k in range(max(0, len(stack) - 8), len(stack)) if stack[k].tag == "p")
            if all(x.tag in INLINE for x in stack[i + 1 :]):
                close(i)
        elif stack[-1].tag in CLOSES.get(tag, ()):
            close(len(stack) - 1)
        if tag in VOID or _closes_itself(attributes):
            continue
        above = stack[-1]
        if tag in RAW:
            shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag not in SILENT:
                say(page[at : shut.start() if shut else end])
            at = shut.end() if shut else end
            continue
        number += 1
        inline = tag in INLINE
        prior = above.prior + _node_prior(tag, attributes, bool(opened["article"]))
        where = (above.depth, above.block, above.parent, above.block_tag) if inline else (above.depth + 1, number, above.block, tag)
        stack.append(Open(tag, prior, above.silent or tag in SILENT, *where))
        opened[tag] += 1
    flush()
    return blocks


def log_odds(b: Block) -> float:
    """Classifier: log-odds that a block is content."""
    z = BIAS + LINKED * b.linked + LENGTH * math.log1p(b.words) + b.prior
    if b.text[-1] in ".!?。”\"'…" and b.words > 3:
        z += SENTENCE
    if PHRASE.match(b.text):
        z += PHRASED
    if b.tag in ("h1", "h2", "h3", "h4"):
        z += 0.5
    return max(-FARTHEST, min(FARTHEST, z))


class Network:
    """Max-flow by shortest augmenting paths in level graphs, on few nodes."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def levels(self, source: int) -> list[int]:
        level, queue = [-1] * len(self.edges), deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Nodes on the source's side of a minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            tried = [0] * len(self.edges)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    full = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                out = self.edges[a]
                while tried[a] < len(out):
                    e = out[tried[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    a = self.to[path.pop() ^ 1]
                    tried[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def label(blocks: list[Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    n = len(blocks)
    costs = [log_odds(b) for b in blocks]
    if all(z > 0 for z in costs) or all(z <= 0 for z in costs):
        return [z > 0 for z in costs]  # the cut that severs no smoothness edge is then the cheapest
    net, source, sink = Network(n + 2), n, n + 1
    for i, z in enumerate(costs):
        if z > 0:
            net.add(source, i, z)
        else:
            net.add(i, sink, -z)
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            weight = NEXT_TO / (1 + abs(blocks[i - 1].depth - b.depth)) + SHARED * max(0, b.shared - 2)
            net.add(i - 1, i, weight, weight)
        if (j := last.get(b.parent)) is not None and j < i - 1:
            net.add(j, i, SHARED, SHARED)  # siblings that others part
        last[b.parent] = i
    return net.source_side(source, sink)[:n]


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by one space; empty for null, empty and textless pages."""
    if not page:
        return ""
    blocks = read_blocks(page)
    return " ".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep) if blocks else ""


@F.pandas_udf(T.StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, html_col: str | Column = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of every row; repeated rows and other columns stay. No shuffle."""
    return pages.withColumn(out, main_text_udf(F.col(html_col) if isinstance(html_col, str) else html_col))
