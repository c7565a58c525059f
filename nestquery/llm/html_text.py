"""HTML extraction by composite text density.

For every node of a page's tree: C characters and T tags below it, LC and LT of them in links. Its density is C/T times
the logarithm of (C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e), where b is the body; 0 counts as 1 in a
denominator. Here the base is e at least, which the published formula doesn't say: it gives a base of 1 for a page without
links, to which there is no logarithm, and bases near 1 for short texts on pages with few, where the logarithm explodes. A node's density sum is the sum of its children's densities. The threshold is the least density on the path
from the node of the greatest density sum up to the body. From the body down, each node of at least that density marks
the subtree of the greatest density sum in it; the text of the marked subtrees, in the order of the page, is the content.

Defined results: NULL gives NULL, an empty page or one without text an empty string and density 0. Text outside any tag
counts as the body's. Unclosed, misnested and unknown tags, stray ``<`` and cut-off pages parse as far as they go; what
scripts, styles, comments and the head hold is no text. Of equal density sums (ties) the first node is taken. An empty table has no rows. Repeated rows are
extracted each; NULL ids are carried through; extra columns are ignored. Nesting is followed to any depth.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title head svg".split())
_RAW_TEXT = frozenset("script style textarea title".split())
#: A tag that closes an open one of these kinds first.
CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
#: Where an implied end stops looking.
SCOPE = frozenset("table ul ol dl body html article section div td th".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_SPACES = re.compile(r"\s+")
_END = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")


class Tree:
    """Nodes in the order of the page: tag, parent, nearest block, and pieces of text with their node. The time is linear in
    the page: counts of open tags, in all and since the last element of ``SCOPE``, tell whether there is anything to close."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.block = ["body"], [-1], [0]
        self.texts: list[tuple[int, str]] = []
        stack = [0]
        self.open: dict[str, int] = {}
        self.scopes: list[tuple[str, dict[str, int]]] = [("body", {})]
        self.raw = 0  # open elements whose text is none
        at, n = 0, len(page)
        low: str | None = None
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._text(stack, page[at:lt])
            if lt == n:
                break
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            name = _NAME.match(page, lt + 1)
            if not name:
                self._text(stack, "<")
                at = lt + 1
                continue
            end = page.find(">", name.end())
            if end < 0:
                break
            if '"' in page[name.end() : end] or "'" in page[name.end() : end]:
                whole = _END.match(page, name.end())
                end = whole.end() - 1 if whole else end
            at = end + 1
            tag = name[1].lower()
            if page[lt + 1] == "/":
                self._close(stack, tag)
                continue
            if tag in ("html", "body"):
                continue
            for open_tag in CLOSES.get(tag, ()):
                self._imply(stack, open_tag)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.block.append(node if tag in BLOCK else self.block[stack[-1]])
            if tag in VOID or page[end - 1] == "/":
                continue
            if tag in _RAW_TEXT:
                if low is None:
                    low = page.lower()
                    if len(low) != n:  # a lower case of another length
                        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), page)
                stop = low.find(f"</{tag}", at)
                if stop < 0:
                    break
                end = page.find(">", stop)
                at = n if end < 0 else end + 1
                continue
            stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
            if tag in SCOPE:
                self.scopes.append((tag, {}))
            else:
                inside = self.scopes[-1][1]
                inside[tag] = inside.get(tag, 0) + 1
            if tag in RAW:
                self.raw += 1

    def _text(self, stack: list[int], s: str) -> None:
        if not self.raw:
            s = html.unescape(s) if "&" in s else s
            self.texts.append((stack[-1], s))

    def _close(self, stack: list[int], tag: str) -> None:
        """Closes the last open element of a tag, and what is open in it."""
        last = ""
        while self.open.get(tag) and last != tag:
            last = self.tag[stack.pop()]
            self.open[last] -= 1
            if last in SCOPE:
                self.scopes.pop()
            else:
                self.scopes[-1][1][last] -= 1
            self.raw -= last in RAW

    def _imply(self, stack: list[int], tag: str) -> None:
        """The same, if it is within the last element of ``SCOPE`` or is that."""
        scope, inside = self.scopes[-1]
        if inside.get(tag) or (scope == tag and len(self.scopes) > 1):
            self._close(stack, tag)


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Density and density sum of every node."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, s in tree.texts:
        chars[node] += sum(map(len, s.split()))
    for v in range(n - 1, -1, -1):
        if tree.tag[v] == "a":
            link_chars[v], link_tags[v] = chars[v], tags[v]
        p = tree.parent[v]
        if p >= 0:
            chars[p] += chars[v]
            tags[p] += tags[v] + 1
            link_chars[p] += link_chars[v]
            link_tags[p] += link_tags[v] + (tree.tag[v] == "a")
    ratio = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for v in range(n - 1, -1, -1):
        c, t, lc, lt = chars[v], max(1, tags[v]), link_chars[v], max(1, link_tags[v])
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            value = c / max(1, lc) * t / lt
            density[v] = c / t * math.log(value) / max(1.0, math.log(base)) if value > 0 else 0.0
        if tree.parent[v] >= 0:
            total[tree.parent[v]] += density[v]
    return density, total


def extract(page: str) -> tuple[str, float, float]:
    """Content, greatest density sum and threshold of a page."""
    tree = Tree(page)
    density, total = densities(tree)
    n = len(tree.tag)
    if not any(density):
        return "", 0.0, 0.0
    # the node of the greatest sum in each subtree, the first of equals; a leaf stands for itself
    top = list(range(n))
    for v in range(n - 1, 0, -1):
        p = tree.parent[v]
        if total[top[v]] > total[top[p]] or (total[top[v]] == total[top[p]] and top[v] < top[p]):
            top[p] = top[v]
    threshold, v = density[top[0]], top[0]
    while v >= 0:
        threshold = min(threshold, density[v])
        v = tree.parent[v]
    reached, marked = [False] * n, [False] * n
    for v in range(n):
        p = tree.parent[v]
        reached[v] = (p < 0 or reached[p]) and density[v] >= threshold - 1e-9
        if reached[v]:
            marked[top[v]] = True
    for v in range(1, n):
        marked[v] = marked[v] or marked[tree.parent[v]]
    out, last = [], -1
    for node, s in tree.texts:
        if marked[node]:
            block = tree.block[node]
            out.append(("\n" if block != last and out else "") + (s if s.isalnum() else _SPACES.sub(" ", s)))
            last = block
    text = "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())
    return text, total[top[0]], threshold


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, density_sum, threshold: one row for each page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [None if p is None else extract(p) for p in part.column("html").to_pylist()]
                text, top, least = (zip(*[f or (None, None, None) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([None if t is None else len(t) for t in text], pa.int64()), pa.array(top, pa.float64()), pa.array(least, pa.float64())], names=["page_id", "url", "text", "n_chars", "density_sum", "threshold"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long, density_sum double, threshold double")
