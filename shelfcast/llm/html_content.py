"""Main text of web pages by tag-path ratios.

A page is read as text nodes, each with its root-to-leaf path of tags (and class names). All nodes
of a path and prior are judged together (so never visible text with hidden): their mean length of
text outside links, raised by punctuation. The
ratios are smoothed over neighbouring nodes and fused with what the path itself says: nothing for
tags of menus, footers and forms, a tenth for names such as ``sidebar`` or ``cookie-banner``, more
inside an article. Paths below a share of the page's best are left out. An article with a path
above it is kept whole, short blocks too, but for what its tags or names rule out. A name is only a
factor: where nothing else on the page is longer, what lies below it is the content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import STEP_BYTES, column, pieces, text_bytes

_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"[ \t\n\x0b\f\r   -     　]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "head", "body"}
_NOT_CONTENT = frozenset("nav footer aside dialog menu head".split())
#: What belongs to forms; inside a paragraph a label or a button is a part of it.
_CONTROLS = frozenset("button label".split())
#: Names of parts around the content. A class name counts if its first or last part is one of these:
#: ``sidebar``, ``sidebar-left`` and ``main-sidebar``, but not ``with-sidebar``.
_AROUND = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice popup promo promoted related replies reply search share sharing "
    "sidebar signup social sponsor sponsored subscribe widget".split()
)
_STATES = frozenset("with has have no not without is show hide".split())
_OF_CONTENT = frozenset("article content entry page-content post story".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Part of the page's best fused ratio that a path needs, and what an article's paths count.
THRESHOLD, ARTICLE = 0.25, 4.0
#: What a path counts whose names say that it is around the content, and an article inside such a one.
AROUND, ARTICLE_AROUND = 0.1, 0.25
#: Times the page's length that tag ends may be looked for in vain before quotes are not minded.
_PATIENCE = 8
#: Weights of a node's neighbours and of itself in the smoothing.
SMOOTHING = (0.25, 0.5, 0.25)


@dataclass
class Node:
    """A run of text: its path and block by number, whether links hold it, what its place counts, its
    article's number (0: none), whether its names say that it is around the content."""

    path: int
    block: int
    text: str
    link: bool
    prior: float
    article: int
    around: bool


@dataclass
class _Open:
    tag: str
    path: int
    prior: float
    link: bool
    article: int
    around: bool


def _names(more: str) -> list[str]:
    """Class names, id and role, without digits."""
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(more)).lower()
    return _DIGITS.sub("", found).split()


def is_around(name: str, tag: str = "div", inside: bool = False) -> bool:
    """Whether a class name says that its element is around the content. ``inside``: in an article,
    where a header is the article's own."""
    parts = [p for p in _PARTS.split(name) if p]
    if not parts or parts[0] in _STATES:
        return False
    which = {parts[0], parts[-1]} & _AROUND
    if "header" in which and (inside or tag in _HEADINGS or not _OF_CONTENT.isdisjoint(parts)):
        which = which - {"header"}
    return bool(which)


class _Scanner:
    """Finds where tags end, in a time that grows with the page's length alone."""

    def __init__(self, page: str):
        self.page, self.last, self.spent = page, page.rfind(">"), 0

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends before ``at``; -1 if there is none.
        One inside quotes doesn't count, unless the quotes are never closed."""
        if at > self.last:
            return -1
        here = at
        while self.spent <= _PATIENCE * len(self.page):
            found = _STOP.search(self.page, here)
            if found and found[0] == ">":
                return found.start()
            close = self.page.find(found[0], found.end()) if found else -1
            if close < 0:
                self.spent += len(self.page) - at
                break
            here = close + 1
        return self.page.find(">", at)


def text_nodes(page: str) -> Iterator[Node]:
    """The page's text runs in order. Broken markup is read as browsers do: unknown end tags are
    skipped, a new block ends an open paragraph, what is open at the end ends there. Time and memory
    grow with the page's length, however deep or broken its markup."""
    stack: list[_Open] = []
    where: dict[str, list[int]] = {}  # of each tag, its places in the stack
    paths: dict[tuple[int, str], int] = {}
    block = at = articles = 0
    scanner, lower = _Scanner(page), None
    bottom = _Open("", 0, 1.0, False, 0, False)

    def here(text: str) -> Node:
        top = stack[-1] if stack else bottom
        return Node(top.path, block, text, top.link, top.prior, top.article, top.around)

    def close(depth: int) -> None:
        for gone in stack[depth:]:
            where[gone.tag].pop()
        del stack[depth:]

    while at < len(page):
        begin = page.find("<", at)
        while 0 <= begin and not (page[begin + 1 : begin + 2] in ("!", "?") or _TAG.match(page, begin + 1)):
            begin = page.find("<", begin + 1)
        if begin < 0:
            yield here(html.unescape(page[at:]))
            return
        if begin > at:
            yield here(html.unescape(page[at:begin]))
        if page[begin + 1] in "!?":
            mark = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(mark, begin + 2)
            at = len(page) if end < 0 else end + len(mark)
            continue
        name = _TAG.match(page, begin + 1)
        end = scanner.end(name.end())
        if end < 0:  # a tag that never ends isn't text, and neither is what follows
            return
        tag, more, at = name[1].lower(), page[name.end() : end], end + 1
        if tag == "br":
            yield here(" ")
            continue
        if page[begin + 1] == "/":
            if where.get(tag):
                close(where[tag][-1])
            block += tag in _BLOCK
            continue
        block += tag in _BLOCK
        if tag in _CLOSES_P and where.get("p"):
            close(where["p"][-1])
        if tag in _VOID:
            continue
        if tag in _RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) == len(page):
                end = lower.find(f"</{tag}", at)
            else:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                end = found.start() if found else -1
            at = len(page) if end < 0 else end
            continue
        if tag == "li" and where.get("li"):
            inner = max((where[t][-1] for t in ("ul", "ol") if where.get(t)), default=-1)
            if where["li"][-1] > inner:
                close(where["li"][-1])
        top = stack[-1] if stack else bottom
        prior, article, around = top.prior, top.article, top.around
        names = _names(more) if more else []
        root = tag in ("html", "body")
        if more and not root and _HIDDEN.search(more):
            prior = -1.0
        elif prior >= 0 and (tag in ("article", "main") or tag == "div" and "main" in names):
            if not article:  # one inside another is a part of it
                prior = ARTICLE * (ARTICLE_AROUND if around else 1)
                articles += 1
                article, around = articles, False
        elif tag in _NOT_CONTENT or tag == "header" and not article:
            prior = -1.0
        elif prior > 0 and (tag == "form" or tag in _CONTROLS and not where.get("p")):
            prior = 0.0
        elif not root and any(is_around(n, tag, bool(article)) for n in names):
            prior, around = prior * AROUND if not around else prior, True
        step = ".".join([tag, *sorted(set(names))])
        path = paths.setdefault((top.path, step), len(paths) + 1)
        where.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, path, prior, top.link or tag == "a", article, around))


def extract(page: str) -> str:
    """The main text: its blocks in page order, one line each."""
    nodes = [n for n in text_nodes(page) if n.text]
    paths: dict[tuple[int, float], int] = {}
    which = np.array([paths.setdefault((n.path, n.prior), len(paths)) for n in nodes], np.int64)
    if not len(which):
        return ""
    plain = np.array([0 if n.link else len(_SPACE.sub(" ", n.text).strip()) for n in nodes], float)
    marks = np.array([0 if n.link else len(_PUNCTUATION.findall(n.text)) for n in nodes], float)
    linked = np.array([len(n.text.strip()) if n.link else 0 for n in nodes], float)
    filled = np.array([bool(n.text.strip()) for n in nodes], float)
    size = np.bincount(which, plain)
    count = np.maximum(np.bincount(which, filled), 1)
    density = np.bincount(which, linked) / np.maximum(size + np.bincount(which, linked), 1)
    ratio = np.log1p(size / count) * (1 + np.minimum(1, 20 * np.bincount(which, marks) / np.maximum(size, 1)))
    solid = np.flatnonzero(filled)
    if not len(solid):
        return ""
    each = ratio[which[solid]]
    padded = np.concatenate([each[:1], each, each[-1:]])
    smooth = SMOOTHING[0] * padded[:-2] + SMOOTHING[1] * padded[1:-1] + SMOOTHING[2] * padded[2:]
    mean = np.bincount(which[solid], smooth, len(paths)) / np.maximum(np.bincount(which[solid], minlength=len(paths)), 1)
    prior = np.maximum(np.array([prior for _, prior in paths]), 0)
    # a link inside a paragraph is the paragraph's; a path of links alone is none
    fused = prior * mean * np.where(prior >= ARTICLE, 1.0, 1 - density)
    best = fused.max()
    chosen = (fused >= THRESHOLD * best) & (fused > 0)
    articles = {n.article for n, path in zip(nodes, which.tolist(), strict=True) if chosen[path] and n.article and not n.around}
    taken = {n.block for n, path in zip(nodes, which.tolist(), strict=True) if chosen[path]}
    blocks: dict[int, list[str]] = {}
    for node in nodes:  # the block's other parts too, those before its chosen ones as well
        if node.prior > 0 and (node.article in articles and not node.around or node.block in taken):
            blocks.setdefault(node.block, []).append(node.text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def main_text(pages_: DataFrame, page: str = "html") -> DataFrame:
    """Every row with ``text`` (the main text, empty if there is none) and ``n_chars``, its code points.

    A null page counts as empty; markup without text gives an empty text. Columns of these names are
    replaced, the page's column goes, others stay. Pages are read whole, one at a time; time and memory
    grow with a page's length, also where it is deeply nested or its tags never end. Each row is
    judged by itself, so repeated rows get equal texts.
    """
    others = [c for c in pages_.columns if c.lower() not in ("text", "n_chars", page.lower())]
    row = F.struct(F.lit(1).alias("x"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)])
    packed = pages_.select(text_bytes(page).alias("page"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, STEP_BYTES):
                texts = [extract(p.decode("utf-8", "replace")) for p in piece.column(0).to_pylist()]
                texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
                yield pa.record_batch(
                    [piece.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["row", "text", "n_chars"],
                )

    kind = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(run, f"row {kind}, text string, n_chars long")
    return done.select(
        *[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)], "text", "n_chars"
    )
