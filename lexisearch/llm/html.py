"""Main text of web pages from flat text blocks.

A page is cut at block-level tags into a flat sequence of text blocks; nothing of
the tree is kept. A block is described by its number of words and its link density
(share of its words inside links) and those of the block before and after it. A small
decision tree, trained here on the labelled rows of ``LABELLED``, says which blocks are
content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisearch.llm._spark import load

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea)(?![a-z0-9:-]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>"
    r"|<[!?/][^<>]*>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Left out with what is in them where their end tag follows; else only the tag is.
_SKIPPED = {name: re.compile(rf"</{name}\s*>", re.I) for name in "noscript template svg select iframe title".split()}
#: Any other tag ends a head.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_SPACE = re.compile(r"\s+")

#: Words and link density of the block before, the block, and the block after; 1 if the block is content.
LABELLED = (
    # menus and link lists
    (0, 0.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 2, 1.0, 1, 1.0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 0), (3, 1.0, 4, 1.0, 3, 1.0, 0), (1, 1.0, 1, 1.0, 30, 0.0, 0),
    (40, 0.0, 6, 1.0, 5, 1.0, 0), (5, 1.0, 8, 0.9, 6, 1.0, 0), (12, 0.8, 25, 0.7, 10, 0.9, 0), (0, 0.0, 3, 0.7, 2, 1.0, 0), (80, 0.0, 14, 0.8, 2, 1.0, 0), (6, 1.0, 40, 0.6, 6, 1.0, 0),
    # banners and notices between a menu and the text
    (1, 1.0, 6, 0.0, 9, 0.0, 0), (1, 1.0, 8, 0.0, 10, 0.0, 0), (1, 1.0, 11, 0.0, 12, 0.0, 0), (1, 1.0, 9, 0.0, 60, 0.0, 0), (2, 1.0, 5, 0.0, 4, 0.0, 0), (1, 1.0, 13, 0.0, 3, 0.0, 0), (1, 1.0, 3, 0.0, 2, 0.0, 0), (3, 1.0, 20, 0.2, 8, 0.0, 0),
    # page ends: last block of the page
    (60, 0.0, 8, 0.0, 0, 0.0, 0), (120, 0.0, 11, 0.0, 0, 0.0, 0), (25, 0.0, 6, 0.0, 0, 0.0, 0), (9, 0.0, 10, 0.0, 0, 0.0, 0), (1, 0.0, 9, 0.0, 0, 0.0, 0), (300, 0.0, 14, 0.1, 0, 0.0, 0), (45, 0.0, 4, 0.5, 0, 0.0, 0), (12, 0.0, 18, 0.3, 0, 0.0, 0), (5, 0.0, 3, 0.0, 0, 0.0, 0),
    # headings
    (8, 0.0, 7, 0.0, 60, 0.0, 1), (11, 0.0, 10, 0.0, 12, 0.0, 1), (6, 0.0, 12, 0.0, 9, 0.0, 1), (9, 0.0, 3, 0.0, 80, 0.0, 1), (90, 0.0, 2, 0.0, 70, 0.0, 1), (40, 0.0, 5, 0.0, 33, 0.0, 1), (5, 0.0, 1, 0.0, 4, 0.0, 1), (9, 0.0, 2, 0.0, 2, 0.0, 1),
    # paragraphs
    (10, 0.0, 60, 0.0, 80, 0.0, 1), (60, 0.0, 120, 0.0, 45, 0.0, 1), (50, 0.0, 30, 0.0, 9, 0.0, 1), (120, 0.0, 200, 0.1, 90, 0.0, 1), (70, 0.0, 22, 0.0, 8, 0.0, 1), (33, 0.0, 400, 0.0, 11, 0.0, 1), (15, 0.0, 75, 0.2, 60, 0.3, 1), (200, 0.0, 35, 0.1, 150, 0.0, 1),
    (2, 1.0, 150, 0.0, 90, 0.0, 1), (1, 1.0, 80, 0.0, 10, 0.0, 1), (80, 0.0, 90, 0.0, 0, 0.0, 1), (9, 0.0, 55, 0.0, 0, 0.0, 1), (0, 0.0, 70, 0.0, 50, 0.0, 1), (0, 0.0, 120, 0.0, 0, 0.0, 1), (0, 0.0, 25, 0.0, 60, 0.0, 1),
    # short paragraphs inside a text
    (80, 0.0, 1, 0.0, 90, 0.0, 1), (60, 0.0, 4, 0.0, 70, 0.0, 1), (25, 0.0, 9, 0.0, 8, 0.0, 1), (7, 0.0, 2, 0.0, 50, 0.0, 1), (100, 0.0, 12, 0.0, 9, 0.0, 1), (40, 0.0, 8, 0.0, 13, 0.0, 1), (5, 0.0, 5, 0.0, 6, 0.0, 1), (3, 0.0, 8, 0.0, 10, 0.0, 1), (50, 0.0, 20, 0.0, 1, 0.0, 1), (9, 0.0, 2, 0.0, 1, 0.0, 1), (1, 0.0, 15, 0.0, 1, 0.0, 1),
    # blocks of three pages as they stand, read and labelled: menu, notice, title, text, imprint
    (0, 0.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0), (1, 1.0, 8, 0.0, 6, 0.0, 0), (8, 0.0, 6, 0.0, 13, 0.0, 1), (6, 0.0, 13, 0.0, 68, 0.0, 1), (13, 0.0, 68, 0.0, 92, 0.0, 1), (49, 0.0, 61, 0.0, 1, 0.0, 1), (61, 0.0, 1, 0.0, 1, 0.0, 1), (1, 0.0, 1, 0.0, 48, 0.0, 1), (34, 0.0, 4, 0.0, 15, 0.0, 1), (64, 0.0, 2, 0.0, 5, 0.0, 1),
    (1, 1.0, 8, 0.0, 7, 0.0, 0), (8, 0.0, 7, 0.0, 7, 0.0, 1), (7, 0.0, 7, 0.0, 22, 0.0, 1), (7, 0.0, 22, 0.0, 33, 0.0, 1), (31, 0.0, 1, 0.0, 94, 0.0, 1), (76, 0.0, 46, 0.0, 8, 0.0, 1), (46, 0.0, 8, 0.0, 0, 0.0, 0),
    (1, 1.0, 1, 1.0, 5, 0.0, 0), (1, 1.0, 5, 0.0, 11, 0.0, 0), (5, 0.0, 11, 0.0, 14, 0.0, 1), (34, 0.0, 210, 0.0, 4, 0.0, 1), (210, 0.0, 4, 0.0, 20, 0.0, 1), (12, 0.0, 2, 0.0, 19, 0.0, 1), (6, 0.0, 9, 0.0, 11, 0.0, 1), (9, 0.0, 11, 0.0, 0, 0.0, 0),
)


@dataclass(frozen=True)
class Node:
    """A leaf's ``share`` of content rows, or a split: ``left`` where feature <= cut."""

    share: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """A decision tree by least Gini impurity; of equal splits the first feature and lowest cut."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return Node(share)
    best = (_gini(y) - 1e-12, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= least and (g := _gini(y[low]) + _gini(y[~low])) < best[0] - 1e-12:
                best = (g, f, float(cut))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))

    def down(node: Node, rows: np.ndarray) -> None:
        if node.feature < 0:
            out[rows] = node.share
        else:
            low = x[rows, node.feature] <= node.cut
            down(node.left, rows[low])
            down(node.right, rows[~low])

    down(tree, np.arange(len(x)))
    return out >= 0.5


@lru_cache(1)
def trained() -> Node:
    table = np.array(LABELLED, float)
    return grow(table[:, :6], table[:, 6])


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each flat block that has text."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = links = at = 0
    head = False
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked
        whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if whole:
            n = whole.count(" ") + 1
            out.append((whole, n, min(linked, n)))
        text.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if links:
                linked += len(raw.split())

    while m := _MARKUP.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                close()
            continue
        name = name.lower()
        if name == "head":
            head = not m[2]
        elif name not in _HEAD:
            head = False
        if name in _SKIPPED and not m[2] and name not in endless and (head or name != "title") and not (name == "svg" and m[0].endswith("/>")):
            if end := _SKIPPED[name].search(page, at):
                at = end.end()
                if name != "svg":
                    close()
                continue
            endless.add(name)
        if name == "svg":
            continue
        if name == "a":
            links = max(0, links - 1) if m[2] else links + 1
        elif name not in _INLINE:
            close()
            links = 0
    take(page[at:])
    close()
    return out


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """Words and link density of the block before, the block and the block after; zeros beyond the ends."""
    own = np.array([(0, 0.0), *((n, k / n) for _, n, k in found), (0, 0.0)])
    return np.hstack([own[:-2], own[1:-1], own[2:]])


def extract(page: str | None, tree: Node | None = None) -> tuple[str, int, int] | None:
    """(text of the content blocks, a line each; blocks; content blocks)."""
    if page is None:
        return None
    found = blocks(page)
    if not found:
        return "", 0, 0
    keep = classify(tree or trained(), features(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k), len(found), int(keep.sum())


EXTRACTED = "page_id bigint, n_blocks int, n_content int, text string"
_EXTRACTED = pa.schema([("page_id", pa.int64()), ("n_blocks", pa.int32()), ("n_content", pa.int32()), ("text", pa.string())])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n_blocks, n_content, text) of every row: the main text, a line a block.

    A narrow pass over whole pages. Null pages give nulls, empty ones or pages without
    text an empty text and no blocks. Repeated rows each give a row; null ids stay null;
    other columns are ignored; an empty table gives an empty result. Unclosed comments,
    scripts, styles and text areas reach to the page's end; a head without an end tag
    ends at the first tag of the body, and of other unclosed elements only the tag goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            got = [extract(x.as_py(), tree) or (None, None, None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], _EXTRACTED.field(f).type) for i, f in ((1, "n_blocks"), (2, "n_content"), (0, "text")))], schema=_EXTRACTED)

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, EXTRACTED)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))
