"""Spelling variants and importance resampling against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from glossweave.llm.importance import OP12_SQL, gains, op12_importance_resampling, resampled
from glossweave.llm.ngrams import Ngrams
from glossweave.llm.spelling import OP11_SQL, near_words, op11_spelling_variants, variant_groups, word_counts


def _same_as_sql(df, sql, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


def _one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups_by_hand(n, least_n=5, ratio=5):
    vocabulary = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_n}
    near = {w: sorted((-k, v) for v, k in vocabulary.items() if _one_apart(w, v)) for w in vocabulary}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= ratio * k else None for w, k in vocabulary.items()}
    out = {}
    for w, k in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, k, len(near[w]), vocabulary.get(form[w]))
    return out


def _rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_query(spark, sf_dir):
    rows = _same_as_sql(op11_spelling_variants(spark, sf_dir), OP11_SQL, sf_dir)
    assert any(r[1] for r in rows) and any(not r[1] for r in rows)


@pytest.mark.parametrize(("shard", "most"), [(1 << 18, 1 << 20), (400, 700), (1 << 18, 300)])
def test_variants(spark, shard, most):
    """Dense words of three letters, with runs, chains of forms and ties; one shard, many, and one hot shard in blocks."""
    r = random.Random(5)
    n = {}
    for _ in range(300):
        n["".join(r.choice("abé") for _ in range(r.randint(4, 9)))] = r.choice([1, 5, 7, 7, 40, 300, 2000])
    n |= {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "aaaaaaaaa": 5000, "x" * 900: 9, "x" * 899 + "y": 90, "zzzzzz": 6}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert _rows(variant_groups(df, shard_chars=shard, most_chars=most)) == _groups_by_hand(n)


def test_variants_of_a_hot_prefix(spark):
    """Half of all words share their beginning; no pair is lost between blocks."""
    r = random.Random(6)
    words = sorted({"common" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(150)} | {"".join(r.choice("abcd") for _ in range(7)) for _ in range(150)})
    got = {x["word"]: x["n_near"] for x in near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), shard_chars=500, most_chars=200).collect()}
    want = {w: sum(_one_apart(w, v) for v in words) for w in words}
    assert got == {w: k for w, k in want.items() if k}


def test_words(spark):
    docs = [(1, "Ab ab AB É é×÷ø 9a"), (None, "ab"), (2, None), (2, ""), (1, "ab"), (3, "q" * 70_000)]
    got = {r["word"]: r["n"] for r in word_counts(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string"), damage=3).collect()}
    want = Counter()
    for doc, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert got == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_counts(empty).filter("n > 0").count() == 0 and variant_groups(word_counts(empty)).count() == 0


def _features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or b"").lower())
    return w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)], len(w)


@pytest.mark.parametrize("few", [False, True])
def test_interning(few):
    """Hashes and checksums are the libraries'; with hashes of seven values only, bytes tell the runs apart."""
    r = random.Random(1)
    texts = [None, b"", b"A b a b  a B", " é!! x\n".encode(), b" ".join(b"w" * r.randint(1, 100) + b"%d" % r.randint(0, 5) for _ in range(400)), b"one", b"--", b"z" * 5000 + b" " + b"z" * 5000, b"a" * 31 + b" " + b"a" * 32]
    grams = Ngrams(texts)
    met = [(int(k), grams.bytes[s : s + z].tobytes()) for k, s, z in zip(grams.of, grams.start, grams.size, strict=True)]
    assert sorted(met) == sorted((k, f) for k, t in enumerate(texts) for f in _features(t)[0])
    assert grams.words.tolist() == [_features(t)[1] for t in texts]
    hashes = grams.hashes()
    assert hashes.tolist() == [xxhash.xxh64_intdigest(f) for _, f in met]
    slot, first = grams.interned(hashes % np.uint64(7) if few else hashes)
    slots = {}
    assert all(slots.setdefault(f, s) == s for (_, f), s in zip(met, slot.tolist(), strict=True)) and len(set(slots.values())) == len(slots) == len(first)
    assert all(met[first[s]][1] == f for f, s in slots.items())
    assert grams.crc32(first).tolist() == [zlib.crc32(met[i][1]) for i in first]
    assert not len(Ngrams([]).interned()[0]) and not len(Ngrams([b"", None]).interned()[0])


def test_resampling_query(spark, sf_dir):
    rows = _same_as_sql(op12_importance_resampling(spark, sf_dir), OP12_SQL, sf_dir)
    drawn = sorted(r[4] for r in rows if r[4])
    assert drawn == list(range(1, len(drawn) + 1)) and 0 < len(drawn) < len(rows)


def test_resampling(spark):
    """By hand, with null ids and texts, rows that repeat, short texts, an empty target and extra columns."""
    r = random.Random(2)
    docs = [(k, " ".join(r.choice("red green blue Ä one two".split()) for _ in range(r.randint(0, 60)))) for k in range(80)] + [(None, "red " * 30), (81, None), (3, "blue " * 25), (3, "blue " * 25)]
    items = ["red green red", None, "", "one two red blue"]
    for target in (items, []):
        df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, rank int, doc string")
        got = resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets=50).collect()
        s, t = Counter(), Counter()
        for count, texts in ((s, [x for _, x in docs]), (t, target)):
            for text in texts:
                count.update(zlib.crc32(f) % 50 for f in _features(text and text.encode())[0])
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
        want = []
        for doc, text in docs:
            f, words = _features(text and text.encode())
            weight = sum(gain[zlib.crc32(x) % 50] for x in f) // max(1, len(f))
            h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
            want.append((doc, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        order = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
        order = order[: len(order) * 25 // 100]
        assert sorted(map(repr, [tuple(x)[:5] for x in got])) == sorted(map(repr, want))
        assert [tuple(x)[:5] for x in sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])] == order
    assert resampled(df.limit(0), df.limit(0)).count() == 0
    assert set(gains(df.limit(0), df.limit(0), buckets=5)) == {0}
