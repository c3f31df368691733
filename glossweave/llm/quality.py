"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words, all of them. Every passage is encoded from dense features (shares of
capitals, digits, marks, bars, symbols and line ends, word length, words that repeat the one before or that differ
within the passage). Gated attention gives each passage a weight, learned from document labels alone; the
weighted mean of the encodings is the document's representation, and a logistic layer scores it.

The model has a few hundred weights and is trained with numpy on the driver, by Adam over small sets of bags, from a
bounded sample of ``max_rows`` labelled training documents taken in the order of a hash of their ids. Encoding and
scoring are Spark jobs over whole texts.

Null and empty texts are one passage without words. Without labels of both kinds all scores are the labels' mean, or
0.5 without any. Null labels are no labels; a document labelled more than once counts as good if one label says so. Repeated
rows are scored each; of several texts under a labelled id the greatest is learned from. A very long text is a bag of many passages. A null id is in no fold: such rows are
scored, aren't held out, and no label is learned from them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossweave.llm.common import forget, in_parts, own_columns, ship, table, written
from glossweave.llm.toxicity import fold, with_score
from glossweave.llm.wordbytes import BANG, BAR, DIGIT, LINE, LOWER, STOP, SYMBOL, UPPER, WIDE, Texts

PASSAGE = 64
FEATURES = 13


def passages(raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of each text's first passage."""
    t = Texts(raw, letters=False)
    count = np.maximum(1, -(-t.words // PASSAGE))
    first = np.cumsum(count) - count
    total = int(count.sum())
    nth = np.arange(len(t.start)) - np.repeat(np.cumsum(t.words) - t.words, t.words)
    of = first[t.of] + nth // PASSAGE  # each word's passage
    head = np.flatnonzero(nth % PASSAGE == 0)
    of_byte = np.zeros(len(t.kind), dtype=np.int64)
    marks = np.zeros(len(t.kind) + 1, dtype=np.int64)
    marks[t.begin] = 1  # a text's bytes begin its first passage, later ones begin at their first word
    later = head[nth[head] > 0]
    marks[t.start[later]] += 1
    of_byte = np.cumsum(marks[:-1]) - 1
    kinds = t.kinds(of_byte, total)
    size = np.maximum(kinds.sum(axis=1), 1)
    letters = np.maximum(kinds[:, [UPPER, LOWER, WIDE]].sum(axis=1), 1)
    n = np.bincount(of, minlength=total)
    words = np.maximum(n, 1)
    length = np.bincount(of, t.end - t.start, total) / words
    word = t.whole()
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    pairs = np.lexsort((word, of))
    fresh = np.ones(len(word), dtype=bool)
    fresh[1:] = (word[pairs][1:] != word[pairs][:-1]) | (of[pairs][1:] != of[pairs][:-1])
    different = np.bincount(of[pairs], fresh, total) / words
    x = np.column_stack([
        kinds[:, UPPER] / letters, kinds[:, DIGIT] / size, kinds[:, STOP] / words, kinds[:, BANG] / words, kinds[:, BAR] / words, kinds[:, SYMBOL] / words, kinds[:, LINE] / words,
        kinds[:, WIDE] / letters, length / 10, np.log1p(length), np.bincount(of, again, total) / words, different, np.log1p(n) / 4,
    ])
    return np.minimum(x, 5.0), first


class Attention:
    """Weights by name; ``forward`` and ``backward`` work on passages of many bags in a row, ``first`` numbers each bag's first."""

    def __init__(self, seed: int = 5, hidden: int = 16, gate: int = 8):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None
        self.w = {
            "enc": r.normal(0, 0.4, (FEATURES, hidden)), "enc0": np.zeros(hidden), "tanh": r.normal(0, 0.3, (hidden, gate)), "sig": r.normal(0, 0.3, (hidden, gate)),
            "att": r.normal(0, 0.3, gate), "out": r.normal(0, 0.3, hidden), "out0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, s = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["sig"])))
        e = (t * s) @ w["att"]
        size = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return z @ w["out"] + w["out0"][0], (x, size, h, t, s, a, z)

    def backward(self, kept: tuple, first: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
        x, size, h, t, s, a, z = kept
        w = self.w
        dz = np.repeat(d[:, None] * w["out"], size, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        dt, ds = de[:, None] * w["att"] * s * (1 - t * t), de[:, None] * w["att"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["tanh"].T + ds @ w["sig"].T) * (1 - h * h)
        return {"enc": x.T @ dh, "enc0": dh.sum(axis=0), "tanh": h.T @ dt, "sig": h.T @ ds, "att": (t * s).T @ de, "out": z.T @ d, "out0": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, *, steps: int = 800, bags: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        ends = np.append(first[1:], len(x))
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            own = r.integers(0, len(first), min(bags, len(first)))
            size = ends[own] - first[own]
            start = np.cumsum(size) - size
            rows = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(first[own], size)
            logit, kept = self.forward(x[rows], start)
            d = (1 / (1 + np.exp(-logit)) - y[own]) / len(own)
            slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.backward(kept, start, d).items():
                g = g + decay * self.w[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] = self.w[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def score(self, raw: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raw), self.constant)
        x, first = passages(raw)
        return 1 / (1 + np.exp(-self.forward((x - self.mean) / self.scale, first)[0]))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in in_parts(batches, "text", rows=256, octets=1 << 20):
        x, first = passages(part.column("text").cast(pa.binary()).to_pylist())
        bags = [b.astype("<f4").tobytes() for b in np.split(x, first[1:])]
        yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "label", max_rows: int = 8000, max_bytes: int = 64 << 20) -> Attention:
    """``labels``: id_col and label_col (0 or 1) of training documents alone. ``max_rows`` and ``max_bytes`` (of encoded
    passages) bound the sample: labelled documents are taken in the order of a hash of their ids until either is full."""
    ship(docs.sparkSession)
    marks = own_columns(labels, doc_id=id_col, label=label_col).filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = own_columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")  # 12 bytes a row, max_rows rows
    rows = rows.groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    bags = written(rows.mapInArrow(_encode, "doc_id long, label int, bag binary"))
    taken = bags.select("doc_id", F.sum(F.octet_length("bag")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("bytes"))  # max_rows rows
    got = bags.join(F.broadcast(taken.filter(F.col("bytes") <= max_bytes).select("doc_id")), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    forget(bags)
    model, y = Attention(), got["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    bags = [np.frombuffer(b, dtype="<f4").reshape(-1, FEATURES) for b in got["bag"]]
    size = np.array([len(b) for b in bags])
    model.fit(np.concatenate(bags).astype(float), np.cumsum(size) - size, y)
    return model


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter("doc_id IS NOT NULL").filter(~held_out)
    scored = with_score(docs, train(docs, labels, label_col="quality"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
