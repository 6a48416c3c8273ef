"""Main-content extraction from HTML by a minimum cut over text blocks.

A page is cut into blocks: the text between tags that aren't inline. A linear
classifier scores each block from its length, link density and surrounding tags; the
score (log-odds in hundredths) becomes a terminal capacity (positive: source, content;
negative: sink, boilerplate). Smoothness edges join neighbouring blocks, with a
capacity that falls with their distance in the DOM, and consecutive blocks of one
parent element. The minimum cut labels the blocks; a block that is on the source side
of every minimum cut is content, so ties go to boilerplate.

The classifier is a logistic regression fitted to a bounded sample of the table: of
the pages that mark their content by an ``article`` or ``main`` element, at most
``TRAIN_PAGES``, with the smallest hashes of identifier and page among some
``4 * TRAIN_PAGES`` of all pages. Blocks inside the element are content; the element
itself is no feature. A Gaussian prior centred at ``PRIOR`` holds what the sample
doesn't tell, so without any such page the prior is the classifier. An ``article`` or
``main`` around a block adds ``MARKED``, which no label can tell.

Capacities are integers. Blocks whose own score outweighs all their edges are
labelled first and folded into their neighbours' scores, which is exact; maximum flow
(blocking flows over shortest paths, in each connected rest) settles what is left.

Scripts, styles, comments and the title don't count, nor do templates, noscript and
svg elements that are closed; unclosed ones are ignored, but an unclosed script,
style or comment runs to the page's end as in browsers. A title that isn't closed
ends at the next tag. The head ends where the first element or text begins that it
can't hold, whether it is closed or not. Unclosed paragraphs and list items end where
HTML ends them, stray end tags are ignored, entities are decoded and white space is
collapsed. A quote in a tag counts after an equals sign only; a ``<`` that no ``>``
follows is text.

Defined cases: a null page has null content and no blocks; an empty page or one
without text has empty content. A very long page takes time in proportion to its
length, apart from the flow. Repeated rows get equal results; an empty table gives an
empty table. Only identifier and page are read; an identifier named like a result
gets underscores behind its name.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .textops import map_text

#: Capacity of the edge between neighbouring blocks with no DOM distance, and of that between siblings.
ADJACENT, SIBLING = 120, 60
#: Pages of the classifier's sample, and weight of its prior against the mean loss of a block.
TRAIN_PAGES, RIDGE = 512, 0.02
#: Prior log-odds in hundredths: constant, per doubling of a block's words, full link density, class or id
#: that names clutter, and each enclosing tag.
PRIOR = {
    "": -260, "words": 90, "links": -400, "clutter": -350,
    "p": 80, "pre": 60, "blockquote": 40, "h1": 120, "h2": 90, "h3": 90, "td": -20,
    "nav": -400, "footer": -400, "aside": -300, "header": -150, "form": -250, "button": -300, "select": -300, "menu": -300, "li": -20,
}
NAMES = list(PRIOR)
#: Tags that mark content, and what they add.
MARKED = {"article": 150, "main": 150}
CLUTTER_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sidebar|menu|nav\w*|footer|cookie\w*|promo\w*|social|share|comments?|related|breadcrumbs?)(?:$|[\s_-])", re.I)

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
_VALUE = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "template", "noscript", "svg")}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("base link meta title script style template noscript".split())
_CLOSES = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

FIELDS = [T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_content", T.IntegerType())]


class Block:
    """A run of text with its score and place.

    ``depth``: elements around it, ``common``: those it shares with the block before,
    ``parent``: number of the element around its own. ``features`` in the order of
    ``NAMES`` and ``marked`` are kept for the classifier's sample only.
    """

    __slots__ = ("common", "depth", "features", "marked", "parent", "score", "text")

    def __init__(self, text: str, depth: int, common: int, parent: int, score: int):
        self.text, self.depth, self.common, self.parent, self.score = text, depth, common, parent, score


class _Tags:
    """Tags of a page in order; every character is passed a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.title = page, None
        self.last = page.rfind(">")
        self.missing: set[str] = set()  # quotes and end tags that don't come again
        self.plain = False  # a tag ends at the first ">"

    def end(self, i: int) -> int:
        """Where the tag that begins at i ends (behind its ">", which exists)."""
        at = i
        while not self.plain:
            m = _VALUE.search(self.page, at)
            if not m:
                self.plain = True
            elif m.group() == ">":
                return m.end()
            else:
                quote = m.group(1)
                close = -1 if quote in self.missing else self.page.find(quote, m.end())
                if close < 0:
                    self.missing.add(quote)
                at = m.end() if close < 0 else close + 1
        return self.page.find(">", i) + 1

    def closing(self, tag: str, at: int) -> re.Match | None:
        """The next end tag, if there is one."""
        if tag in self.missing:
            return None
        m = _END[tag].search(self.page, at)
        if not m:
            self.missing.add(tag)
        return m

    def __iter__(self):
        """(text before, tag in lower case, whether it ends an element, attributes); the last one without a tag."""
        page, at, begin = self.page, 0, 0
        text: list[str] = []
        while True:
            i = page.find("<", at)
            if i >= 0 and page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                text += [page[begin:i], " "]
                begin = at = len(page) if j < 0 else j + 3
                continue
            if i < 0 or i >= self.last:
                text.append(page[begin:])
                yield "".join(text), None, False, ""
                return
            if page[i + 1 : i + 2] in ("!", "?"):
                text += [page[begin:i], " "]
                begin = at = page.find(">", i) + 1
                continue
            m = _NAME.match(page, i + 1)
            if not m:
                at = i + 1
                continue
            text.append(page[begin:i])
            begin = at = self.end(m.end())
            tag, attributes = m.group().lower(), page[m.end() : at - 1]
            if tag in _END:
                close = None if attributes.endswith("/") and tag == "svg" else self.closing(tag, at)
                if tag == "title":
                    j = close.start() if close else page.find("<", at)
                    j = len(page) if j < 0 else j
                    if self.title is None:
                        self.title = page[at:j]
                    begin = at = self.end(j) if close and j < self.last else j
                elif close:
                    begin = at = self.end(close.end()) if close.end() <= self.last else len(page)
                elif tag in ("script", "style"):
                    begin = at = len(page)
                text.append(" ")
                continue
            yield "".join(text), tag.removeprefix("/"), tag[0] == "/", attributes
            text = []


def parse(page: str, weights: dict[str, int] = PRIOR, sample: bool = False) -> tuple[list[Block], str | None]:
    """The page's blocks in order, and its title's source."""
    out: list[Block] = []
    # tag, number, what it adds to the score, its features
    stack: list[tuple[str, int, int, tuple[str, ...]]] = []
    opened: dict[str, int] = {}
    around: dict[str, int] = {}
    words: list[str] = []
    number = linked = total = in_link = score = low = marked = 0
    base, doubling, links, clutter = (weights[x] for x in NAMES[:4])

    def flush() -> None:
        nonlocal linked, total, low
        if words:
            own = base + int(doubling * math.log2(1 + total)) + links * linked // total + score
            b = Block(" ".join(words), len(stack), min(low, len(stack)), stack[-2][1] if len(stack) > 1 else 0, own)
            if sample:
                b.features = [1.0, math.log2(1 + total), linked / total, *[float(around.get(x, 0)) for x in NAMES[3:]]]
                b.marked = marked > 0
            out.append(b)
            words.clear()
            low = len(stack)
        linked = total = 0

    def pop() -> None:
        nonlocal score, low, marked
        tag, _, add, features = stack.pop()
        opened[tag] -= 1
        score -= add
        low = min(low, len(stack))
        marked -= tag in MARKED
        for f in features:
            around[f] -= 1

    tags = _Tags(page)
    for raw, tag, ends, attributes in tags:
        w = (unescape(raw) if "&" in raw else raw).split()
        if w:
            words += w
            total += len(w)
            linked += len(w) * in_link
        if tag is None:
            break
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            continue
        flush()
        in_link = 0
        if tag == "head" or tag in _IN_HEAD:
            continue  # what the head holds beside these is text, and counts
        if ends:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        closes = _CLOSES.get(tag) or (("p",) if tag in _ENDS_P else ())
        while stack and stack[-1][0] in closes:
            pop()
        if tag in _VOID or attributes.endswith("/"):
            continue
        number += 1
        add, features = weights.get(tag, 0) + MARKED.get(tag, 0), (tag,) if tag in PRIOR else ()
        if attributes:
            n = _NAMED.search(attributes)
            if n and CLUTTER_NAMES.search(n.group(1) or n.group(2) or n.group(3) or ""):
                add, features = add + clutter, (*features, "clutter")
        stack.append((tag, number, add, features))
        opened[tag] = opened.get(tag, 0) + 1
        score += add
        marked += tag in MARKED
        for f in features:
            around[f] = around.get(f, 0) + 1
    flush()
    return out, tags.title


def blocks(page: str, weights: dict[str, int] = PRIOR) -> list[Block]:
    """The page's blocks in order."""
    return parse(page, weights)[0]


def edges(found: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness capacities between block numbers i < j."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for j, b in enumerate(found):
        if j:
            out[j - 1, j] = ADJACENT // (1 + found[j - 1].depth + b.depth - 2 * b.common)
        if b.parent in last:
            i = last[b.parent]
            out[i, j] = out.get((i, j), 0) + SIBLING
        last[b.parent] = j
    return out


def cut(score: list[int], edge: dict[tuple[int, int], int]) -> list[bool]:
    """Whether each node is on the source side of every minimum cut."""
    n = len(score)
    s = list(score)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in edge.items():
        if c > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        v = todo.pop()
        if label[v] is not None:
            continue
        held = sum(near[v].values())
        if s[v] > held or -s[v] >= held:
            label[v] = s[v] > held
            for u, c in near[v].items():
                s[u] += c if label[v] else -c
                del near[u][v]
                todo.append(u)
            near[v] = {}
    for v in range(n):
        if label[v] is None:
            rest, at = [v], 0
            label[v] = False
            while at < len(rest):
                for u in near[rest[at]]:
                    if label[u] is None:
                        label[u] = False
                        rest.append(u)
                at += 1
            for u in _reachable(rest, s, near):
                label[u] = True
    return [bool(x) for x in label]


def _reachable(rest: list[int], s: list[int], near: list[dict[int, int]]) -> list[int]:
    """Nodes that the source reaches after a maximum flow: blocking flows over ever longer shortest paths."""
    number = {v: k for k, v in enumerate(rest)}
    r = [{number[u]: c for u, c in near[v].items()} for v in rest]
    sink = [max(0, -s[v]) for v in rest]
    source = [max(0, s[v]) for v in rest]
    while True:
        level = [-1] * len(rest)
        queue = deque()
        for v, c in enumerate(source):
            if c:
                level[v] = 0
                queue.append(v)
        least = None
        while queue:
            v = queue.popleft()
            if least is not None and level[v] >= least:
                continue
            if sink[v]:
                least = level[v]
                continue
            for u, c in r[v].items():
                if c and level[u] < 0:
                    level[u] = level[v] + 1
                    queue.append(u)
        if least is None:
            return [rest[v] for v, x in enumerate(level) if x >= 0]
        step = [iter(()) if x < 0 else iter(list(e)) for x, e in zip(level, r)]
        for start, c in enumerate(source):
            if not c:
                continue
            path = [start]
            while path and source[start]:
                v = path[-1]
                if sink[v]:
                    flow = min(source[start], sink[v], *[r[a][b] for a, b in zip(path, path[1:])])
                    source[start] -= flow
                    sink[v] -= flow
                    keep = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        r[a][b] -= flow
                        r[b][a] += flow
                        if not r[a][b]:
                            keep = min(keep, k + 1)
                    if keep < len(path):
                        del path[keep:]
                    elif not sink[v] and len(path) > 1 and level[v] >= least:
                        path.pop()
                    elif not sink[v] and len(path) == 1 and level[v] >= least:
                        break
                    continue
                for u in step[v]:
                    if r[v][u] and level[u] == level[v] + 1 and level[u] <= least:
                        path.append(u)
                        break
                else:
                    path.pop()


def extract(page: str, weights: dict[str, int] = PRIOR) -> tuple[str, str, int, int]:
    """Title, content (blocks joined by newlines), blocks and content blocks of a page."""
    found, title = parse(page, weights)
    label = cut([b.score for b in found], edges(found))
    kept = [b.text for b, x in zip(found, label) if x]
    return " ".join(unescape(title).split()) if title else "", "\n".join(kept), len(found), len(kept)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-odds of each feature: mean logistic loss and a ridge around PRIOR, by Newton's method."""
    prior = np.array([PRIOR[k] for k in NAMES]) / 100
    w = prior.copy()
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) / len(x) + RIDGE * (w - prior)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + RIDGE * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, int]:
    """Weights in hundredths, fitted to the bounded sample in one task of an executor."""
    ship(pages.sparkSession)
    page = F.col(f"`{html_col}`")
    total = pages.count()
    share = min(1.0, 4 * TRAIN_PAGES / max(1, total))
    h = F.xxhash64(F.col(f"`{id_col}`"), page, F.lit("html"))
    # some TRAIN_PAGES rows reach the sort, however many partitions there are
    few = pages.select(h.alias("h"), page.alias("page")).where((F.col("h") < min(int(share * 2**64) - 2**63, 2**63 - 1)) & F.col("page").rlike("(?i)<(article|main)[\\s>/]"))
    few = few.orderBy("h").limit(TRAIN_PAGES).select("page").coalesce(1)

    def run(batches):
        found = [b for batch in batches for p in batch.column(0).to_pylist() for b in parse(p, sample=True)[0]]
        x = np.array([b.features for b in found]).reshape(-1, len(NAMES))
        w = fit(x, np.array([b.marked for b in found], float))
        yield pa.RecordBatch.from_arrays([pa.array(w.tolist())], names=["w"])

    rows = few.mapInArrow(run, "w double").collect()
    return {k: round(100 * r["w"]) for k, r in zip(NAMES, rows)} if rows else dict(PRIOR)


def _compute(column: pa.Array, weights: dict[str, int]) -> list:
    rows = [(None, None, 0, 0) if (p := x.as_py()) is None else extract(p, weights) for x in column]
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]


def main_content(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, title, content, n_blocks, n_content)`` of every row."""
    weights = train(pages, id_col, html_col)
    return map_text(pages, [id_col], html_col, lambda column: _compute(column, weights), FIELDS)
