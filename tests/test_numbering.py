"""Numbers over whole tables, freezing on them, and the packet of the blind review."""

import hashlib
import random

import pytest

from glossweave.operators import sampling, versions
from glossweave.operators.numbering import numbered

F = pytest.importorskip("pyspark.sql.functions")


def test_numbered(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice([None, 1, 2, 3]), f"x{draw.randint(0, 30)}") for k in range(500)]
    df = spark.createDataFrame(rows, "k int, a int, b string").repartition(7)
    got = sorted(((r["n"], r["k"]) for r in numbered(df, F.desc_nulls_last("a"), "b", "k", name="n").collect()))
    want = sorted(rows, key=lambda r: (-(r[1] or 0), r[2], r[0]))
    assert got == [(n, r[0]) for n, r in enumerate(want, 1)]
    assert numbered(df.limit(0), "k", name="n").count() == 0
    same = numbered(spark.range(100).select(F.lit(1).alias("a")), "a", name="n")
    assert sorted(r["n"] for r in same.collect()) == list(range(1, 101))


def test_freeze(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 7, "x"), ("a", 9, "x"), ("b", 1, "x"), ("b", 2, "x")] + [("hot", k, str(k // 3)) for k in range(300)]
    got = sorted((r["job"], r["version"], r["n"]) for r in versions.freeze(spark.createDataFrame(rows, "job string, n int, glossary_hash string").repartition(5)).collect())
    assert got == [("a", 1, 1), ("a", 2, 3), ("a", 3, 7), ("b", 1, 1)] + [("hot", k + 1, 3 * k) for k in range(100)]


def _plain(rows, most, terms, repairs, long):
    differ = [r for r in rows if r[2] != r[3]]
    hashed = lambda r: hashlib.md5(f"7:{r[0]}".encode()).hexdigest()
    chosen = []

    def add(pool, name):
        for r in pool:
            if len(chosen) < most and r[0] not in dict(chosen):
                chosen.append((r[0], name))

    add(sorted((r for r in differ if r[4]), key=lambda r: (-r[4], r[0]))[:terms], "term_dense")
    add([r for r in differ if r[5]][:repairs], "repair_review")
    add(sorted(differ, key=lambda r: (-len(r[1]) - 8 * r[1].count(". "), r[0]))[:long], "long_dense")
    add(sorted(differ, key=lambda r: (hashed(r), r[0]))[: most - len(chosen)], "random")
    add([r for r in differ if r[0] not in dict(chosen)][: most - len(chosen)], "random_fill")
    add([r for r in rows if r[2] == r[3]][: most - len(chosen)], "identical_fallback")
    return chosen


@pytest.mark.parametrize(("n", "alike"), [(120, 40), (30, 25), (30, 30), (0, 0)])
def test_packet(spark, n, alike):
    draw = random.Random(n)
    rows = [(k, "s. " * draw.randint(0, 9), "t", "t" if k < alike else f"u{k}", draw.randint(0, 3), draw.random() < 0.3) for k in range(n)]
    df = spark.createDataFrame(rows, "seg_idx int, source string, target_a string, target_b string, n_terms int, flagged boolean")
    got = sorted(sampling.blind_packet(df, "seg_idx", most=20, terms=4, repairs=4, long=3).collect(), key=lambda r: r["packet_id"])
    assert [(r["seg_idx"], r["category"]) for r in got] == _plain(rows, 20, 4, 4, 3)
    assert [r["packet_id"] for r in got] == list(range(1, len(got) + 1))
    assert sum(r["left"] == "A" for r in got) == len(got) // 2
    arms = {r[0]: (r[2], r[3]) for r in rows}
    assert all((r["candidate_a"], r["candidate_b"]) == (arms[r["seg_idx"]] if r["left"] == "A" else arms[r["seg_idx"]][::-1]) for r in got)
    counts = {r["category"]: r["n"] for r in sampling.packet_counts(sampling.blind_packet(df, "seg_idx", most=20, terms=4, repairs=4, long=3)).collect()}
    assert counts.get("all", 0) == len(got) and sum(v for k, v in counts.items() if k != "all") == len(got)
