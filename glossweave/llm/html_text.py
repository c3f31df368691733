"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' numbers.

A page becomes a row of text blocks (see ``html_blocks``). A block's features are its words and link density, those of the block before and the one
after, where it stands, and how far that is from the best place that any block of the page has. A decision tree, trained on the small
labelled table of ``html_labelled``, keeps a block or drops it. Kept blocks are joined by one space, in page order.

A null or empty page has the text ''; so has one without any kept block. White space is what Unicode calls so, no-break spaces too. Nothing is cut: a page of
any length is read whole, in one row. Rows stay as they are otherwise, repeated ones and ones with null keys too; an empty table gives an empty one. An input
column with the name of the text's is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import in_parts, ship, table
from glossweave.llm.html_blocks import Block, blocks
from glossweave.llm.html_labelled import labelled

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "zone", "gap", "heading")
DEPTH, LEAF = 8, 2


def features(page: list[Block]) -> np.ndarray:
    """A row for each block of one page."""
    words = np.array([b.words for b in page], dtype=np.float64)
    density = np.array([b.linked for b in page]) / np.maximum(words, 1)
    zone = np.array([b.zone for b in page], dtype=np.float64)
    around = [np.concatenate(x) for v in (words, density) for x in (([0.0], v[:-1]), (v[1:], [0.0]))] if page else [words] * 4
    heading = np.array([b.heading for b in page], dtype=np.float64)
    return np.column_stack((words, density, around[0], around[2], around[1], around[3], zone, zone.max(initial=-9.0) - zone, heading))


class Tree:
    """A binary decision tree, split by Gini impurity. Of equal splits the first feature's with the least border is taken."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, depth: int = DEPTH, leaf: int = LEAF):
        self.feature, self.border, self.low, self.high, self.keep = [], [], [], [], []
        self._grow(x, y, depth, leaf)
        self.feature, self.border, self.low, self.high, self.keep = map(np.array, (self.feature, self.border, self.low, self.high, self.keep))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        me = len(self.feature)
        for column, value in ((self.feature, -1), (self.border, 0.0), (self.low, me), (self.high, me), (self.keep, bool(2 * y.sum() >= len(y)))):
            column.append(value)
        split = self._split(x, y, leaf) if depth and 0 < y.sum() < len(y) else None
        if split:
            self.feature[me], self.border[me] = split
            low = x[:, split[0]] <= split[1]
            self.low[me] = self._grow(x[low], y[low], depth - 1, leaf)
            self.high[me] = self._grow(x[~low], y[~low], depth - 1, leaf)
        return me

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, leaf: int) -> tuple[int, float] | None:
        n, best, found = len(y), y.mean() * (1 - y.mean()) * len(y) - 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, kept = x[order, f], np.cumsum(y[order])
            below = np.arange(1, n)
            p, q = kept[:-1] / below, (kept[-1] - kept[:-1]) / (n - below)
            cost = below * p * (1 - p) + (n - below) * q * (1 - q)
            cost[(v[1:] <= v[:-1]) | (below < leaf) | (n - below < leaf)] = np.inf
            if len(cost) and cost.min() < best:
                k = int(cost.argmin())
                best, found = cost[k], (f, (v[k] + v[k + 1]) / 2)
        return found

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.keep[at]
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.border[node], self.low[node], self.high[node])


@cache
def tree() -> Tree:
    """Trained on the labelled table; a worker trains it once, in some hundredths of a second, and always to the same tree."""
    rows = [(features([b for b, _ in page]), [k for _, k in page]) for page in labelled()]
    return Tree(np.concatenate([x for x, _ in rows]), np.array([k for _, ks in rows for k in ks], dtype=np.float64))


def page_text(html: str | None) -> str:
    page = blocks(html) if html else []
    kept = tree()(features(page)) if page else ()
    return " ".join(b.text for b, k in zip(page, kept, strict=True) if k)


def _extracted(html: str, text: str):
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, html, rows=1000, octets=8 << 20):
            found = pa.array([page_text(x) for x in batch.column(html).to_pylist()], pa.string())
            names = [*(c for c in batch.schema.names if c != text), text]
            yield pa.record_batch([found if c == text else batch.column(c) for c in names], names=names)

    return extracted


def with_main_text(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each as a column."""
    ship(pages.sparkSession)
    fields = ", ".join((*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != text_col), f"`{text_col}` string"))
    return pages.mapInArrow(_extracted(html_col, text_col), fields)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
