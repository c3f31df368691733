"""SimHash, lattice hashing, components, line dedup and decontamination against brute force."""

import duckdb
import numpy as np
import pytest
from brute import leaks
from xxhash import xxh64_intdigest

from glossweave.llm import decontaminate, lattice, near_texts
from glossweave.llm.components import components, spanning
from glossweave.llm.lattice import decode, near_duplicate_vectors, op2_lattice_hashing
from glossweave.llm.line_dedup import OP5_SQL, drop_boilerplate_lines, host_of, op5_line_dedup
from glossweave.llm.near_texts import keep_one_of_each, similar_components
from glossweave.llm.simhash import links, op1_simhash_pivots, simhash_components

F = pytest.importorskip("pyspark.sql.functions")


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _by_hand(docs):
    prints = {i: _fingerprint(t) for i, t in docs}
    ids = sorted(prints)
    sets = Sets(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                sets.join(a, b)
    return {i: (f"{prints[i]:016x}", sets.find(i)) for i in ids}


TEXTS = [None, "", " \n", "one", "One", "one two", "a b c", "A  b\tc", "a b c d", "éa b ñ É", " ".join(f"w{k}" for k in range(9000)), " ".join(f"w{k}" for k in range(8999)), "a b c"]


def test_simhash(spark, sf_dir):
    docs = [(k, t, 1, "x") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp int, component string")
    want = _by_hand([(k, t) for k, t, *_ in docs])
    got = {r["doc_id"]: (f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash_components(df).collect()}
    assert got == want
    assert simhash_components(df.limit(0)).count() == 0
    assert simhash_components(spark.createDataFrame([(None, "a"), (5, "a"), (5, "a")], "doc_id long, text string")).count() == 3
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash_pivots(spark, sf_dir).collect()}
    assert got == _by_hand(rows)


def test_pivot_links(spark):
    r = np.random.default_rng(1)
    prints = set()
    for base in r.integers(-(1 << 62), 1 << 62, 60).tolist():
        for _ in range(20):
            x = base
            for _ in range(r.integers(0, 4)):
                x ^= 1 << int(r.integers(0, 62))
            prints.add(x)
    prints = sorted(prints)
    got = [(min(x), max(x)) for x in links(spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp long, rep long")).collect()]
    a = np.array(prints, dtype=np.int64).view(np.uint64)
    want = {(i, i + 1 + int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2)}
    assert len(got) == len(set(got))
    assert set(got) == want


def test_components(spark):
    r = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    sets = Sets({x for p in pairs for x in p if x is not None})
    for a, b in pairs:
        if a is not None:
            sets.join(a, b)
    want = {x: sets.find(x) for a, b in pairs if a is not None and a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want
    assert len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each(spark):
    base = " ".join(f"word{k}" for k in range(200)).split()
    near = [*base]
    near[100] = "other"
    far = [x if k % 4 else "else" for k, x in enumerate(base)]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, ""), (6, None), (7, "short text"), (8, "short  text"), (None, "no id")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, component string")
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 3, 5, 7]
    assert keep_one_of_each(docs.limit(0)).count() == 0
    # a large group of variants of one text: all but one go, and others stay
    r = np.random.default_rng(3)
    many = []
    for k in range(150):
        v = [*base]
        v[int(r.integers(0, 200))] = f"v{k}"
        many.append((k, " ".join(v)))
    many.append((900, " ".join(f"else{k}" for k in range(50))))
    assert {x["doc_id"] for x in keep_one_of_each(spark.createDataFrame(many, "doc_id long, text string")).collect()} == {0, 900}


def test_e8():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 8)) * 2
    p = decode(x)
    twice = (2 * p).astype(int)
    assert (2 * p == twice).all()
    assert ((twice % 2).sum(axis=1) % 8 == 0).all()
    assert (p.sum(axis=1) % 2 == 0).all()
    assert ((x - p) ** 2).sum(axis=1).max() <= 1 + 1e-9  # E8's covering radius


def test_vectors(spark, sf_dir, monkeypatch):
    r = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(40):
            c = r.normal(size=64)
            for spread in (0, 0, 0.02, 0.1, 0.15):
                rows.append((k, (c + spread * r.normal(size=64) * (spread > 0)).tolist(), label, 1))
                k += 1
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [(1000 + n, v, 0, 1) for n, v in enumerate(odd)] + [(2000, rows[0][1], None, 1), (2001, [1e-200] * 64, 0, 1), (2002, [1e200] * 64, 0, 1), (2003, [1.0, 2.0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    good = [(i, np.array(v), la) for i, v, la, _ in rows if i < 1000 or i in (2001, 2002, 2003)]
    sets, n = Sets([x[0] for x in rows]), dict.fromkeys([x[0] for x in rows], 0)
    for a in range(len(good)):
        for b in range(a):
            (i, x, la), (j, y, lb) = good[b], good[a]
            if la == lb and len(x) == len(y) and (x / abs(x).max()) @ (y / abs(y).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(y / abs(y).max()) >= 0.98:
                n[i] += 1
                n[j] += 1
                sets.join(i, j)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] <= n[i] for i in n)
    assert sum(x for x, _ in got.values()) >= 0.995 * sum(n.values())
    assert sum(got[i][1] == sets.find(i) for i in n) >= 0.99 * len(n)
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    monkeypatch.setattr(lattice, "BLOCK", 5)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()} == got
    # labels are compared as they are, whatever their type
    one = [[1.0, 0.0], [1.0, 0.01]]
    for kind, labels in (("double", (1.2, 1.7)), ("double", (0.0, -0.0)), ("string", ("a", "b")), ("string", ("a", "a"))):
        pair = spark.createDataFrame([(k, v, x) for k, (v, x) in enumerate(zip(one, labels, strict=True))], f"vec_id long, embedding array<float>, label {kind}")
        assert {r["n_links"] for r in near_duplicate_vectors(pair).collect()} == {int(labels[0] == labels[1])}
    every = op2_lattice_hashing(spark, sf_dir)
    assert every.columns == ["vec_id", "n_links", "component_id", "kept"]
    vectors = {r["vec_id"]: r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = list(vectors)
    x = np.array([vectors[i]["embedding"] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([[vectors[i]["label"] == vectors[j]["label"] is not None for j in ids] for i in ids])
    linked = (x @ x.T >= 0.98) & same & ~np.eye(len(ids), dtype=bool)
    assert {r["vec_id"]: r["n_links"] for r in every.collect()} == dict(zip(ids, linked.sum(axis=1).tolist(), strict=True))


def test_line_dedup(spark, sf_dir, tmp_path):
    page = "doc_id long, source string, text string, host string, drop string"
    rows = [(k, "s", f"menu\nown {k}\n\n menu ", "x", "y") for k in range(5)] + [(9, "s", None, "x", "y"), (10, None, "menu\nlonely", "x", "y"), (11, "s", "menu", "x", "y"), (12, "s", "", "x", "y")]
    df = spark.createDataFrame(rows, page)
    out = drop_boilerplate_lines(df, host=F.col("source"))
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {**{k: f"own {k}\n" for k in range(5)}, 9: None, 10: "menu\nlonely", 11: "", 12: ""}
    assert drop_boilerplate_lines(df.limit(0), host=F.col("source")).count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, text, n_lines, n_dropped FROM ({OP5_SQL})").fetchall())
    assert sorted(tuple(r) for r in op5_line_dedup(spark, sf_dir).select("doc_id", "text", "n_lines", "n_dropped").collect()) == want


def test_line_dedup_by_the_host_of_a_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(1, "https://WWW.a.org/x", "menu\none"), (2, "http://a.org:80/y?z", "menu\ntwo"), (3, "https://a.org", "menu\nthree"), (4, "https://b.org/", "menu\nfour"), (5, "no address", "menu"), (6, None, "menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["html"] for r in drop_boilerplate_lines(df, host=host_of(F.col("url")), text_col="html").collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "menu\nfour", 5: "menu", 6: "menu"}
    by = {}
    every = [(r["page_id"], r["url"].split("/")[2].lower().removeprefix("www."), r["html"]) for r in pages.collect()]
    for i, host, html in every:
        for line in {x.strip(" ") for x in html.split("\n")} - {""}:
            by.setdefault((host, line), set()).add(i)
    size = {}
    for _, host, _ in every:
        size[host] = size.get(host, 0) + 1
    bad = {k for k, own in by.items() if len(own) >= 3 and len(own) >= 0.1 * size[k[0]]}
    want = {i: "\n".join(x for x in html.split("\n") if (host, x.strip(" ")) not in bad) for i, host, html in every}
    assert {r["page_id"]: r["html"] for r in drop_boilerplate_lines(pages, host=host_of(F.col("url")), text_col="html").collect()} == want


def test_decontamination(spark, sf_dir):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "just three words"), (3, None), (4, "--"), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (6, "just three words"), (7, "words just three words just")]
    docs = [
        (1, f"x {item.upper()}! y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "Just, three\nwords. just three words"), (4, None), (5, ""), (6, "é " * 30000 + item), (7, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"),
        (8, "three words just three words just"), (9, "a0 9z"),
    ]
    want = leaks(docs, items)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, spans int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for shard in (1 << 20, 40):  # one automaton, and several
        for r in decontaminate.leak_spans(d, b, shard_bytes=shard).collect():
            n, hit, found, _, _ = want[r["doc_id"]]
            assert (r["n_words"], sum(x["last"] - x["first"] + 1 for x in r["spans"]), len(r["items"])) == (n, hit, found)
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove_leaks(d, b, max_coverage=0.9).collect()}
    assert kept[1] == "x ! y"
    assert kept[9] == "a0 9z"
    assert 3 not in kept
    assert kept[4] is None
    assert decontaminate.leak_spans(d.limit(0), b).count() == 0
    assert {r["n_words"] for r in decontaminate.leak_spans(d.filter("doc_id = 9"), b.limit(0)).collect()} == {2}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    tests = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = leaks(rows, tests)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.op9_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == want


def test_near_texts_of_unlike_repeats_and_of_few_words(spark):
    r = np.random.default_rng(6)
    texts, pairs = [], []

    def add(a, b, near):
        texts.extend([a, b])
        pairs.append((len(texts) - 2, len(texts) - 1, near))

    # the same shingles, a line often repeated in one of both: similarity 1 or nearly
    for k in range(12):
        body = [f"b{k}x{n}" for n in range(300)]
        line = [f"l{k}x{n}" for n in range(12)]
        add(" ".join(body + 2 * line), " ".join(body + (20 + 8 * k) * line), True)
    # few words: 5 shingles of which 4 are the other's, a similarity of 0.8; and 4 of which 3 are, 0.75
    for k in range(600):
        add(" ".join(f"s{k}x{n}" for n in range(9)), " ".join(f"s{k}x{n}" for n in range(8)), True)
    for k in range(50):
        add(" ".join(f"t{k}x{n}" for n in range(8)), " ".join(f"t{k}x{n}" for n in range(7)), False)
    order = r.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(order[k], t) for k, t in enumerate(texts)], "doc_id long, text string")
    of = {x["node"]: x["component"] for x in similar_components(docs).collect()}
    met = [(near, of.get(order[a], order[a]) == of.get(order[b], order[b])) for a, b, near in pairs]
    assert all(got for near, got in met[:12])
    assert sum(got for near, got in met[12:612]) >= 599
    assert not any(got for near, got in met[612:])


def test_shards_of_items_keep_rows_of_repeated_and_null_ids_apart(spark):
    a, b = (" ".join(f"{x}{n}" for n in range(12)) for x in "pq")
    items = spark.createDataFrame([(1, a), (2, b), (3, "three short words"), (4, " ".join(f"p{n}" for n in range(6, 20)))], "item_id long, text string")
    texts = [a + " x" * 30, "y " * 40 + b, "clean", None, f"{a} p12 p13 {b}" + " z" * 99, "three short words and more words here", f"u v {b} w", ""]
    ids = [7, 7, 7, None, None, 8, None, 8]
    docs = spark.createDataFrame([(i, t, k, "s") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, key long, spans string").repartition(3)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    one = rows(decontaminate.leak_spans(docs, items))
    assert len(one) == len(texts)
    kept = rows(decontaminate.remove_leaks(docs, items))
    assert len(kept) < len(texts)
    for shard in (20, 60, 150):
        assert rows(decontaminate.leak_spans(docs, items, shard_bytes=shard)) == one
        few = decontaminate.remove_leaks(docs, items, shard_bytes=shard)
        assert few.columns == docs.columns
        assert rows(few) == kept
    body = docs.withColumnRenamed("text", "body")
    assert rows(decontaminate.remove_leaks(body, items, text_col="body", shard_bytes=60)) == kept


def test_common_and_spanning():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 400, int(n)).astype(np.uint64)) for n in r.integers(0, 300, 130)]
    both = near_texts.common(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(130) for j in range(i, 130))
    linked = (both >= 100) & ~np.eye(130, dtype=bool)
    up = Sets(range(130))
    for i, j in np.argwhere(linked):
        up.join(int(i), int(j))
    a, b = spanning(linked)
    assert {int(y): int(x) for x, y in zip(a, b, strict=True)} == {k: up.find(k) for k in range(130) if up.find(k) != k}


def test_large_group_whose_leader_is_not_alike_to_all(spark, monkeypatch):
    """A chain of variants: neighbours are alike, ends aren't; in blocks of a few nodes as in one."""
    r = np.random.default_rng(9)
    text, chain = [f"w{k}" for k in range(150)], []
    for k in range(240):
        text = [*text]
        text[int(r.integers(0, 150))] = f"v{k}"
        chain.append((k, " ".join(text)))
    other = [(1000 + k, " ".join(f"o{k}_{n}" if n % 3 == 0 else f"w{n}" for n in range(150))) for k in range(60)]
    rows = [(*x, "a", 1) for x in [*chain, *other, (3, "other text of a document"), (2000, "other text of a document"), (None, chain[0][1])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, size int")
    want = {0, None} | {k for k, _ in other}
    for nodes in (1024, 50):
        monkeypatch.setattr(near_texts, "BLOCK_NODES", nodes)
        assert {x["doc_id"] for x in keep_one_of_each(docs).collect()} == want


def test_strangers_in_the_key_of_a_large_group(spark, monkeypatch):
    """Every two nodes of different groups share a block, and a large group beside a few strangers is so many rows as it has nodes, and some."""
    monkeypatch.setattr(near_texts, "BLOCK_NODES", 16)
    r = np.random.default_rng(3)
    rows = [(1, k, 1, 5) for k in range(300)] + [(1, 1000 + k, 1000 + k, 5) for k in range(5)]
    rows += [(2, 2000 + k, int(g), 5) for k, g in enumerate(r.integers(0, 4, 80))]
    df = spark.createDataFrame(rows, "gid long, rep long, group long, size int")
    met = near_texts._across_groups(df, "gid").collect()
    blocks = {}
    for x in met:
        blocks.setdefault((x["gid"], x["block"]), []).append(x)
    seen = set()
    for own in blocks.values():
        assert len({x["own"] for x in own}) <= 2
        for x in own:
            for y in own:
                if x["group"] < y["group"] and (x["own"] != y["own"] or len({z["own"] for z in own}) == 1):
                    assert (x["rep"], y["rep"]) not in seen
                    seen.add((x["rep"], y["rep"]))
    assert seen == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2]}
    assert sum(x["gid"] == 1 for x in met) <= 300 + 5 * (300 // 16 + 3)


def test_near_texts_by_pivots_alone(spark, monkeypatch):
    """Texts whose fingerprints lie within 2 bits meet by the pivot tables, also if they share no key of least shingles."""
    words = [f"w{k}" for k in range(4000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1])), (4, " ".join(["an", *words[1:]]))], "doc_id long, text string")
    monkeypatch.setattr(near_texts, "_sketch", _without_keys(near_texts._sketch))
    assert {tuple(x) for x in similar_components(docs).collect()} == {(1, 1), (2, 1), (4, 1)}


def _without_keys(sketch):
    def of(size):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for part in sketch(size)(batches):
                keys = [np.arange(12) + 100 * i for i in part.column("doc_id").to_pylist()]
                yield part.set_column(part.schema.get_field_index("bands"), "bands", pa.array(keys, pa.list_(pa.int64())))

        return run

    return of
