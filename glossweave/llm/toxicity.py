"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learned from labels: word beginnings of 4 to 8 bytes that stand in toxic training documents far more
often than in clean ones, with the logarithm of that ratio as weight. Features of a text: how many of its words
the lexicon holds, per word and in all, their mean and largest weight, the rate of second-person words and of
lexicon words near one, of capitals, punctuation, exclamation marks, symbols, digits and obfuscated words (letters
with digits or symbols between them), and the number of words.

Training rows are split in two. The lexicon of each half gives the features of the other, so trees see a
lexicon's worth on texts it wasn't learned from; trees of each half score the other, and isotonic regression of labels
on these scores calibrates. The trees that are applied are grown on all training rows, over a lexicon of all.

Labels are read from a bounded sample of ``max_rows`` labelled training documents, in the order of a hash of their
ids. Counting the lexicon, features and scores are Spark jobs; only lexicon entries (``max_lexicon`` at most), the
sample's features and labels come to the driver, where the trees are grown with numpy.

Null and empty texts are scored like any other, with features of 0. Without labels of both kinds all scores are 0.
Labels that are null are no labels; a document labelled more than once is toxic if one label says so. Repeated rows are scored
each; of several texts under a labelled id the greatest is learned from. A very long text is scored by itself, whole. Ties of trees' splits go to the
lower feature. A column of the score's name is replaced. A null id is in no fold: such rows are scored, aren't held out, and no label is learned from them. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import forget, in_parts, own_columns, ship, table, written
from glossweave.llm.wordbytes import BANG, DIGIT, LOWER, STOP, SYMBOL, UPPER, WIDE, Texts

# Second-person words.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "toi", "te", "ton", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
FEATURES = 12
SIZES = (4, 5, 6, 7, 8)


def _entry(word: str) -> tuple[int, int]:
    raw = word.encode()[:8]
    return int.from_bytes(raw, "little"), len(raw)


class Lexicon:
    def __init__(self, entries: list[tuple[int, int, float]]):
        """(size, beginning as an integer, weight)"""
        self.by_size = {}
        for k in SIZES:
            own = sorted((key, w) for size, key, w in entries if size == k)
            self.by_size[k] = np.array([x for x, _ in own], dtype=np.uint64), np.array([w for _, w in own])

    def weights(self, texts: Texts) -> np.ndarray:
        """Of each word: its largest weight, 0 for none."""
        out = np.zeros(len(texts.start))
        for k, (keys, weights) in self.by_size.items():
            if len(keys):
                heads = texts.heads(k)
                at = np.minimum(np.searchsorted(keys, heads), len(keys) - 1)
                out = np.maximum(out, np.where(keys[at] == heads, weights[at], 0))
        return out


def features(raw: list[bytes | None], lexicon: Lexicon) -> np.ndarray:
    t = Texts(raw, letters=True)
    words = np.maximum(t.words, 1)
    w = lexicon.weights(t)
    hit = w > 0
    size = t.end - t.start
    you = np.zeros(len(size), dtype=bool)
    for word in SECOND_PERSON:
        key, n = _entry(word)
        you |= (size == n) & (t.heads(n) == key)
    hits = np.bincount(t.of, hit, t.n)
    at, at_you = np.flatnonzero(hit), np.flatnonzero(you)
    near = np.zeros(t.n)
    if len(at) and len(at_you):
        right = np.minimum(np.searchsorted(at_you, at), len(at_you) - 1)
        left = np.maximum(right - 1, 0)
        close = ((np.abs(at_you[right] - at) <= 5) & (t.of[at_you[right]] == t.of[at])) | ((np.abs(at_you[left] - at) <= 5) & (t.of[at_you[left]] == t.of[at]))
        near = np.bincount(t.of[at], close, t.n)
    most = np.zeros(t.n)
    np.maximum.at(most, t.of, w)
    kinds = t.kinds(t.text_of_byte(), t.n)
    letter = np.isin(t.kind, (UPPER, LOWER, WIDE))
    odd = np.isin(t.kind, (DIGIT, SYMBOL, BANG))
    mixed = np.flatnonzero(odd[1:-1] & letter[:-2] & letter[2:]) + 1
    mixed = np.bincount(np.searchsorted(t.begin, mixed, side="right") - 1, minlength=t.n)
    size = np.maximum(t.size, 1)
    letters = np.maximum(kinds[:, [UPPER, LOWER, WIDE]].sum(axis=1), 1)
    you = np.bincount(t.of, you, t.n)
    return np.column_stack([
        hits / words, np.log1p(hits), np.bincount(t.of, w, t.n) / words, most, you / words, near / words, kinds[:, UPPER] / letters,
        kinds[:, STOP] / size, kinds[:, BANG] / size, (kinds[:, SYMBOL] + kinds[:, DIGIT]) / size, mixed / words, np.log1p(t.words),
    ])


class Trees:
    """Boosted regression trees on the logistic loss, each grown a level at a time on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0):
        self.depth = depth
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)])
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(prior / (1 - prior)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), dtype=np.int64)
            which, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                n, off = 2**level, 2**level - 1
                best = np.full(n, 1e-6)
                pick = np.full(n, -1)
                where = np.zeros(n, dtype=np.int64)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = node * (len(c) + 1) + binned[:, j]
                    gs = np.bincount(key, g, n * (len(c) + 1)).reshape(n, -1).cumsum(axis=1)
                    hs = np.bincount(key, h, n * (len(c) + 1)).reshape(n, -1).cumsum(axis=1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain[(hl < least) | (ht - hl < least)] = -1
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(n), k] > best
                    best[better], pick[better], where[better] = gain[np.arange(n), k][better], j, k[better]
                right = np.zeros(len(y), dtype=bool)
                for i in np.flatnonzero(pick >= 0):
                    which[off + i], cut[off + i] = pick[i], cuts[pick[i]][where[i]]
                    own = node == i
                    right[own] = binned[own, pick[i]] > where[i]
                node = 2 * node + right
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf = rate * gs / (hs + ridge)
            f += leaf[node]
            self.trees.append((which, cut, leaf))

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, which[at]] > cut[at])
            f += leaf[node]
        return f


class Isotonic:
    """Pool-adjacent-violators; between two pools' centres the value runs straight."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            pools.append([a, b, 1.0])
            while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][0] == pools[-1][0]):
                (a1, b1, n1), (a2, b2, n2) = pools[-2:]
                pools[-2:] = [[(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2]]
        self.x, self.y = np.array([p[0] for p in pools]), np.array([p[1] for p in pools])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1)


class Model:
    def __init__(self, entries: list, trees: Trees | None, calibrate: Isotonic | None):
        self.entries, self.trees, self.calibrate = entries, trees, calibrate
        self.lexicon = Lexicon(entries)

    def score(self, raw: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(raw))
        margin = self.trees.margin(features(raw, self.lexicon))
        # a hundredth of the trees' own probability keeps the order within a pool
        return 0.99 * self.calibrate(margin) + 0.01 / (1 + np.exp(-margin))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_parts(batches, "text", rows=512, octets=1 << 20)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each half and label each word beginning stands; one sum for each task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in _parts(batches):
        t = Texts(_texts(batch), letters=True)
        cell = np.array(batch.column("half").to_pylist()) * 2 + np.array(batch.column("label").to_pylist())
        for k in SIZES:
            heads = t.heads(k)
            pairs = np.unique(np.column_stack([heads, t.of.astype(np.uint64)])[heads > 0], axis=0)
            keys, at = np.unique(pairs[:, 0], return_inverse=True)
            n = np.bincount(at * 4 + cell[pairs[:, 1].astype(np.int64)], minlength=4 * len(keys)).reshape(-1, 4)
            for key, row in zip(keys.tolist(), n, strict=True):
                old = sums.get((k, key))
                sums[k, key] = row if old is None else old + row
    rows = list(sums.items())
    for k in range(0, max(1, len(rows)), 50_000):
        part = rows[k : k + 50_000]
        n = np.array([r for _, r in part], dtype=np.int64).reshape(-1, 4)
        yield pa.record_batch([pa.array([s for (s, _), _ in part], pa.int32()), pa.array(np.array([x for (_, x), _ in part], dtype=np.uint64).view(np.int64)), *[pa.array(n[:, j]) for j in range(4)]], names=["size", "head", "c0", "t0", "c1", "t1"])


def _features(lexicons) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(x) for x in lexicons.value]
        for batch in _parts(batches):
            raw, half = _texts(batch), np.array(batch.column("half").to_pylist())
            every = [features(raw, x) for x in own]
            cross = np.where((half == 0)[:, None], every[1], every[0])  # the other half's lexicon
            yield pa.record_batch([batch.column("half"), batch.column("label"), pa.array(list(cross), pa.list_(pa.float64()))], names=["half", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "label", max_rows: int = 20_000, max_lexicon: int = 4000, least_ratio: float = 6.0) -> Model:
    """``labels``: id_col and label_col (0 or 1) of training documents alone. ``max_rows``: bound of the sample."""
    ship(docs.sparkSession)
    marks = own_columns(labels, doc_id=id_col, label=label_col).filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    rows = own_columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")  # 12 bytes a row, max_rows rows
    rows = written(rows.groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("text", "label", half))
    total = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    if not all(any(total.get((h, y)) for h in (0, 1)) for y in (0, 1)):
        return Model([], None, None)
    counts = rows.mapInArrow(_beginnings, "size int, head long, c0 long, t0 long, c1 long, t1 long").groupBy("size", "head").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])

    def lexicon(halves: tuple[int, ...]) -> list[tuple[int, int, float]]:
        toxic, clean = (sum(total.get((h, y), 0) for h in halves) for y in (1, 0))
        t, c = sum(F.col(f"t{h}") for h in halves), sum(F.col(f"c{h}") for h in halves)
        weight = F.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))
        best = counts.select("size", "head", t.alias("t"), weight.alias("weight")).filter((F.col("t") >= max(3, toxic // 200)) & (F.col("weight") >= float(np.log(least_ratio))))
        best = best.orderBy(F.desc(F.col("t") * F.col("weight")), "size", "head").limit(max_lexicon).collect()
        return [(r["size"], r["head"] % (1 << 64), r["weight"]) for r in best]

    counts = written(counts.filter("t0 + t1 >= 3"))
    spark = docs.sparkSession
    lexicons = spark.sparkContext.broadcast([lexicon((0,)), lexicon((1,))])
    got = rows.mapInArrow(_features(lexicons), "half int, label int, x array<double>").toPandas()
    final = lexicon((0, 1))
    forget(rows, counts)
    x, y, h = np.array(got["x"].tolist()).reshape(-1, FEATURES), got["label"].to_numpy(dtype=float), got["half"].to_numpy()
    order = np.lexsort((*x.T, y, h))  # the same trees however the rows came
    x, y, h = x[order], y[order], h[order]
    if all(len(set(y[h == k])) == 2 for k in (0, 1)):
        out = np.zeros(len(y))
        for k in (0, 1):
            out[h == k] = Trees(x[h != k], y[h != k]).margin(x[h == k])
        trees = Trees(x, y)
    else:
        trees = Trees(x, y)
        out = trees.margin(x)
    return Model(final, trees, Isotonic(out, y))


def _score(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in _parts(batches):
            score = pa.array(own.score(_texts(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "__score"])

    return run


def with_score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one more column, or with that column anew."""
    ship(docs.sparkSession)
    docs = docs.drop(score_col)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" if c != text_col else "text" for k, c in enumerate(names)])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", `__score` double"
    return plain.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), kind).toDF(*names, score_col)


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string")) % parts


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    scored = with_score(docs, train(docs, labels, label_col="toxic"))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
