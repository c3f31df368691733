"""The pipeline's stages on a small corpus, each against what it must do by hand."""

import corpus_pipeline
from brute import leaks

from glossweave.llm.common import new_path

MID = "/root/testdata/sf0.01"


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MID).write.parquet(path := new_path(spark))
        docs = spark.read.parquet(path)
        after[name] = docs
        if name != "packing":
            assert docs.columns == columns
    texts = {n: {r["doc_id"]: r["text"] for r in df.collect()} for n, df in after.items() if n != "packing"}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{MID}/labels.parquet").filter("toxic = 1").collect()}
    all_docs = spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all_docs - len(texts["toxicity"]) >= 0.8 * len(toxic)
    assert len(set(texts["toxicity"]) & toxic) <= 0.15 * len(toxic)
    assert set(texts["line_dedup"]) == set(texts["toxicity"])
    # near-duplicates, by comparing all that share a shingle
    sets = {i: _shingles(t) for i, t in texts["line_dedup"].items()}
    by = {}
    for i, s in sets.items():
        for x in s or {None}:
            by.setdefault(x, []).append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for own in by.values() for a in own for b in own if a < b}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert set(texts["near_dedup"]) == {i for i in sets if find(i) == i}
    items = [tuple(r) for r in spark.read.parquet(f"{MID}/benchmark.parquet").select("item_id", "text").collect()]
    hit = dict(leaks(list(texts["near_dedup"].items()), items))
    for i, (n, k, *_) in hit.items():
        assert (i in texts["decontamination"]) == (k <= 0.5 * n)
        if k == 0:
            assert texts["decontamination"][i] == texts["near_dedup"][i]
    left = leaks(list(texts["decontamination"].items()), items)
    assert sum(k for _, k, *_ in left.values()) <= 0.02 * sum(k for _, k, *_ in hit.values())
    packed = after["packing"]
    assert packed.select("doc_id").distinct().count() == len(texts["decontamination"])
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.count() > 0


def test_line_dedup_on_large_and_small_hosts(spark):
    passage = " ".join(f"shared{n}" for n in range(55))
    large = [(k, "large", f"own {k}" + (f"\n{passage}" if k % 20 == 0 else "") + ("\nrare" if k % 200 == 0 else "")) for k in range(1000)]
    small = [(2000 + k, "small", "the first line\nthe second line") for k in range(6)] + [(2100 + k, "small", f"other {k}") for k in range(24)]
    # copies don't make their host larger either: a menu on 3 of 21 distinct pages, beside 79 copies of one
    menu = [(3000 + k, "menu", f"page {k}" + ("\nhome | about" if k < 3 else "")) for k in range(20)] + [(3100 + k, "menu", "copied") for k in range(80)]
    rows = [(i, t, "en", s, len(t)) for i, s, t in large + small + menu]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, MID).collect()}
    want = {i: t.replace(f"\n{passage}", "").replace("\nhome | about", "") for i, _, t in large + small + menu}
    assert got == want


ODD = [
    (1, "plain text of a few words", "en", "s", 25, 0.1, "a"), (1, "plain text of a few words", "en", "s", 25, 0.2, "b"), (1, "another text under the same id", "en", "s", 30, 0.3, "c"), (2, "plain text of a few words", None, None, None, 0.4, None),
    (3, "", "en", "s", 0, None, "d"), (4, None, None, None, None, None, None), (None, "a text that has no id", "en", "s", 21, 0.5, "e"), (None, None, None, None, None, None, None), (5, "long " * 60000, "en", "t", 300000, 0.6, "f"),
]


def test_odd_rows_and_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"
    docs = spark.createDataFrame(ODD, kind)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, MID).write.parquet(path := new_path(spark))
        docs = spark.read.parquet(path)
        kept[name] = docs
        if name != "packing":
            assert docs.dtypes == spark.createDataFrame([], kind).dtypes
    ids = {n: sorted((r["doc_id"] or 0) for r in df.collect()) for n, df in kept.items()}
    assert ids["toxicity"] == ids["line_dedup"] == [0, 0, 1, 1, 1, 2, 3, 4, 5]
    assert ids["near_dedup"] == ids["decontamination"] == [0, 0, 1, 1, 1, 3, 5]
    assert sorted(set(ids["packing"])) == [0, 1, 3, 5]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], kind), MID).count() == 0, name
