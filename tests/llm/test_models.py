"""Trained operators: what can be computed by hand, held-out accuracy, and rows that are odd."""

import math
import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from glossweave.llm import language_model, quality, toxicity
from glossweave.llm.wordbytes import Texts

ODD = [None, "", " \n\t", "x", "é" * 50, "word " * 30000, "?!|*", "\0"]
MID = "/root/testdata/sf0.01"


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    _, inverse = np.unique(np.array(score)[order], return_inverse=True)
    n = np.bincount(inverse)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    y = np.array(label)[order]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_words():
    t = Texts([b"Ab, c\nd", None, b"", b"xyz"], letters=True)
    assert t.words.tolist() == [3, 0, 0, 1]
    assert t.of.tolist() == [0, 0, 0, 3]
    assert t.heads(2).tolist() == [int.from_bytes(b"ab", "little"), 0, 0, int.from_bytes(b"xy", "little")]
    assert t.kinds(t.text_of_byte(), 4).sum(axis=1).tolist() == [8, 1, 1, 4]
    same = Texts([b"one two one", b"two"], letters=False).whole()
    assert same[0] == same[2] != same[1] == same[3]
    assert Texts([None, b""], letters=False).whole().tolist() == []


@pytest.mark.parametrize(("query", "label", "parts", "held"), [(toxicity.op4_toxicity, "toxic", 5, 0), (quality.op6_quality, "quality", 3, 1)])
def test_held_out(spark, query, label, parts, held):
    got = {r["doc_id"]: r for r in query(spark, MID).collect()}
    assert len(got) == spark.read.parquet(f"{MID}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % parts == held)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    rows = [(got[r["doc_id"]]["score"], r[label]) for r in spark.read.parquet(f"{MID}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert _auc(*zip(*rows, strict=True)) > 0.95


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    docs = spark.createDataFrame([(k, t, 0.5, "c1") for k, t in enumerate(ODD)] + [(k + 100, f"bad{k} nasty word !!! {k}" if k % 2 else f"fine {k} words here", 0.5, "c2") for k in range(60)], "doc_id long, text string, score double, c0 string")
    labels = spark.createDataFrame([(k + 100, k % 2, "x") for k in range(60)] + [(1, None, "x"), (100, 0, "x"), (None, 1, "x"), (99999, 1, "x")], "doc_id long, mark int, text string")
    model = module.train(docs, labels, label_col="mark")
    out = toxicity.with_score(docs, model, score_col="new")
    assert out.columns == [*docs.columns, "new"]
    got = {r["doc_id"]: r["new"] for r in out.collect()}
    assert len(got) == len(ODD) + 60
    assert all(0 <= x <= 1 for x in got.values())
    assert _auc([got[k + 100] for k in range(60)], [k % 2 for k in range(60)]) > 0.9
    assert toxicity.with_score(docs.limit(0), model, score_col="new").count() == 0
    nothing = toxicity.with_score(docs, module.train(docs, labels.limit(0), label_col="mark"), score_col="new")
    assert nothing.count() == len(got)


def test_isotonic_and_trees():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert _auc(toxicity.Trees(x, y).margin(x), y.astype(int)) > 0.95
    f = toxicity.Isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert f(np.array([-1.0, 0, 1.5, 3, 9])).tolist() == [0, 0, 0.5, 1, 1]


def test_attention_gradient():
    r = np.random.default_rng(2)
    model = quality.Attention()
    x, first, y = r.normal(size=(9, quality.FEATURES)), np.array([0, 4, 6]), np.array([1.0, 0, 1])

    def loss():
        z = model.forward(x, first)[0]
        return np.log1p(np.exp(-np.where(y == 1, z, -z))).sum()

    z, kept = model.forward(x, first)
    g = model.backward(kept, first, 1 / (1 + np.exp(-z)) - y)
    for k, w in model.w.items():
        at = tuple(int(r.integers(0, s)) for s in w.shape)
        old, e = w[at], 1e-6
        w[at] = old + e
        up = loss()
        w[at] = old - e
        assert abs((up - loss()) / (2 * e) - g[k][at]) < 1e-5
        w[at] = old


def _base(docs, train):
    words = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in docs}
    c = Counter(w for i in words if train(i) for w in words[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in words.items()}


def test_language_model(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = _base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r["doc_id"]: r for r in language_model.op7_language_model(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * (1 + abs(base))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_odd_rows(spark, monkeypatch):
    rows = [(k, t, 1.0) for k, t in enumerate([*ODD[:5], "word " * 3000])] + [(7, "same words"), (8, "same words")]
    rows = [(*r, 1.0)[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    want = _base([r[:2] for r in rows], lambda i: i != 3)
    got = {r["doc_id"]: r for r in language_model.language_model_scores(docs, "doc_id <> 3", frequent=3).collect()}
    for i, (n, known, total, base) in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert abs(got[i]["base_score"] - base) < 1e-6 * (1 + abs(base))
    assert language_model.language_model_scores(docs.limit(0), "true").count() == 0
    assert language_model.language_model_scores(docs, "false").filter("base_score = 0").count() == len(rows)


def test_normalised():
    """Over all words, those without a number and one unseen word of each class among them, probabilities sum to 1."""
    r = np.random.default_rng(3)
    letters = language_model.LETTER_CLASSES
    counts = np.sort(r.integers(1, 900, 700))[::-1].astype(float)
    by_letters, others = r.integers(0, letters, 700), r.integers(0, letters, 50)
    k = 400
    tokens = np.bincount(by_letters[k:], counts[k:], letters) + 3 * np.bincount(others, minlength=letters)
    types = np.bincount(by_letters[k:], minlength=letters) + np.bincount(others, minlength=letters)
    model = language_model.Model(r.random((k, 2 * language_model.AROUND)), counts, by_letters, tokens, types, 60)
    draws = np.minimum(r.geometric(0.01, (3000, 3)), 700 + letters)
    before = [x.copy() for x in model.w.values()]
    model.fit(draws, least_steps=30, batch=256)
    assert all((x != y).any() for x, y in zip(before, model.w.values(), strict=True))
    model.start_scoring()
    every = np.arange(700 + letters + 1)
    for two, one in [(model.end, model.end), (3, 7), (k + 2, 350)]:
        p = 10 ** model.log10(np.full(len(every), two), np.full(len(every), one), every)
        assert abs(p.sum() + (4 * np.bincount(others, minlength=letters) * p[700 : 700 + letters]).sum() - 1) < 1e-5


def test_language_model_of_context():
    """A word that always follows another is far likelier there than elsewhere."""
    r = np.random.default_rng(4)
    counts = np.full(200, 500.0)
    draws = r.integers(0, 200, (20000, 3))
    draws[:, 2] = (draws[:, 1] + 1) % 200
    around = np.zeros((200, 2 * language_model.AROUND))
    around[np.arange(200), np.arange(200) % (2 * language_model.AROUND)] = 9
    model = language_model.Model(around, counts, np.zeros(200, dtype=int), np.zeros(language_model.LETTER_CLASSES), np.zeros(language_model.LETTER_CLASSES), 10)
    model.fit(draws, least_steps=500, batch=1024)
    model.start_scoring()
    one = np.arange(200)
    right, wrong = (model.log10(one, one, (one + k) % 200) for k in (1, 5))
    assert np.median(right - wrong) > 1.5


def test_language_model_learns_all_text(spark):
    """Without any draws on the driver, tasks learn which word follows which, from each token once."""
    counts = np.full(200, 1200.0)
    around = np.zeros((200, 2 * language_model.AROUND))
    around[np.arange(200), np.arange(200) % (2 * language_model.AROUND)] = 9
    none = np.zeros(language_model.LETTER_CLASSES)
    model = language_model.Model(around, counts, np.zeros(200, dtype=int), none, none, 10)
    text = np.append(np.arange(30_000) % 200, 200 + language_model.LETTER_CLASSES)
    texts = spark.createDataFrame([(k, np.roll(text[:-1], k).tolist() + [int(text[-1])]) for k in range(8)], "uid long, ids array<int>").repartition(2)
    raw = texts.rdd.map(lambda r: (r.uid, bytearray(np.array(r.ids, dtype="<i4").tobytes())))
    n = 8 * len(text)
    assert language_model.learn_all(model, spark.createDataFrame(raw, "uid long, ids binary"), n, rate=0.05) == n
    model.start_scoring()
    one = np.arange(200)
    right, wrong = (model.log10((one - 1) % 200, one, (one + k) % 200) for k in (1, 5))
    assert np.median(right - wrong) > 0.5


_COST = """
import time
import numpy as np
import pyarrow as pa
from glossweave.llm import language_model as lm

r = np.random.default_rng(6)
k, letters, n = 8192, lm.LETTER_CLASSES, 1 << 15
counts = np.sort(r.zipf(1.3, 20_000).clip(1, 10**6))[::-1].astype(float)
none = np.zeros(letters)
model = lm.Model(r.random((k, 2 * lm.AROUND)), counts, r.integers(0, letters, len(counts)), none + 1e4, none + 1e3, 60)
ids = r.choice(len(counts), n, p=counts / counts.sum())
one, two = lm._context(model.x[ids], model.end)
model.start_scoring()
a, b = r.random((n, 32), dtype=np.float32), r.random((32, 116), dtype=np.float32)
texts = [" ".join(f"word{x}" for x in r.integers(0, 1 << 15, 500)) for _ in range(600)]
docs = pa.record_batch([pa.array(texts)], names=["text"])

def took(run):
    t = time.process_time()
    run()
    return time.process_time() - t

runs = (lambda: [t.lower().split() for t in texts]), (lambda: list(lm._count_words(iter([docs])))), (lambda: np.exp(a @ b)), (lambda: model.log10(two, one, ids))
plain, counting, products, scoring = np.min([[took(run) for run in runs] for _ in range(25)], axis=0)
print(counting / plain, scoring / products)
"""


def test_language_model_cost():
    """CPU time on one thread: of counting words in that of splitting them, and of scoring in that of the products of each token's vector with those of all classes."""
    found = subprocess.run([sys.executable, "-c", _COST], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"})
    counting, scoring = map(float, found.stdout.split())
    assert counting < 4
    assert scoring < 2.6


def test_language_model_split():
    """Words are those of bytes.lower().split(), whatever bytes a text holds."""
    texts = [*ODD, "\u00c9 A\x1cB", " lead", "trail ", "a\x0bb\x0cc\rd\x85e\xa0f\x1f\x1e", "\0 \0Q", "A" * 5000 + " Z", *(f"{chr(k)}K{chr(k)}" for k in range(0x200))]
    want = [(t or "").encode().lower().split() for t in texts]
    words, size = language_model.split(pa.array(texts))
    assert words.to_pylist() == [w for t in want for w in t]
    assert size.tolist() == [len(t) for t in want]
    assert len(language_model.split(pa.array([], pa.string()))[0]) == 0
    assert language_model.split(pa.array([b"\xff\xfe A\xc3 B", None, b" \xe9"]))[0].to_pylist() == [b"\xff\xfe", b"a\xc3", b"b", b"\xe9"]


def test_language_model_sums_and_classes():
    """Sums by place, of places with few and many rows; and a word's class doesn't hang on the words beside it."""
    r = np.random.default_rng(8)
    at, rows = np.concatenate((r.integers(0, 50, 300), np.full(200, 7), [49])), r.random((501, 3))
    want = np.zeros((60, 3))
    np.add.at(want, at, rows)
    assert np.allclose(language_model._sums(at, rows, 60), want)
    words = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 30, 31, 32, 33, 200, 5, 5)]
    letters = language_model.letter_classes(words)
    each = [language_model.class_by_letters(letters, [w])[0] for w in words]
    assert language_model.class_by_letters(letters, words).tolist() == each
    pairs, first = language_model.letter_pairs(words)
    assert np.add.reduceat(letters[pairs], first, axis=0).argmax(axis=1).tolist() == each


@pytest.mark.parametrize("query", [toxicity.op4_toxicity, quality.op6_quality])
def test_null_ids_and_empty_tables_in_queries(spark, tmp_path, query):
    """Rows without an id are scored and in no fold."""
    docs = [(None, "a b c"), (None, None), (1, "plain words"), (2, "")]
    for name, few in (("some", docs), ("none", [])):
        spark.createDataFrame(few, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(None, 1, 1), (1, 0, 0), (2, 1, 1)] if few else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = query(spark, f"{tmp_path}/some").collect()
    assert len(rows) == 4 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert query(spark, f"{tmp_path}/none").count() == 0
