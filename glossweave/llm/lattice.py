"""Embedding near-dedup by lattice hashing.

In each of ``TABLES`` tables a vector's direction is projected on random orthonormal axes, eight by eight, scaled, and each
eight coordinates are decoded to the nearest point of the E8 lattice; the points together are the vector's cell. A
vector is stored in its own cell and looks into the ``PROBES`` cells nearest to it: those of the lattice points that
differ from its own by shortest lattice vectors, in the order of summed squared distance. Vectors with equal labels that
meet are a candidate pair; every candidate is verified by its cosine in double precision.

Equal vectors are one node with their number, so copies are never paired. A cell's vectors are compared in a task as a matrix,
a hot cell's in blocks. A link counts in the first table that brings its two vectors together, which the task finds out by
probing again. A task gives a count for each vector and the links that span its groups, so rows stay linear in the vectors of a block.

Labels of any type are compared as they are. Vectors that are null, of norm zero, or with null or non-finite components link with nothing, nor do vectors without a label
or without an id, nor vectors of different length. Repeated rows are linked as copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import forget, groups, own_columns, ship, table, written
from glossweave.llm.components import components, spanning

TABLES, PROBES, POINTS, SCALE = 5, 16, 2, 5.0


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two of eight coordinates +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        v = np.array([-0.5 if m >> k & 1 else 0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


_SHORTEST = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Rounded, and where the sum is odd the coordinate that rounding moved most goes the other way."""
    r = np.round(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        gap = x[odd] - r[odd]
        k = np.abs(gap).argmax(axis=1)
        r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _axes(dim: int, t: int, points: int) -> np.ndarray:
    r = np.random.default_rng([dim, t, 23])
    return np.linalg.qr(r.normal(size=(max(dim, 8 * points), 8 * points)))[0][:dim]


_MIX = np.random.default_rng(29).integers(1, 1 << 62, (8, 8), dtype=np.int64) | 1


def _cell(points: np.ndarray, t: int, block: int) -> np.ndarray:
    """A 64-bit number for each lattice point."""
    return ((2 * points).astype(np.int64) * _MIX[block % 8] * (2 * (t + 64 * block) + 3)).sum(axis=-1)


def cells(x: np.ndarray, t: int, *, points: int, scale: float, probes: int) -> np.ndarray:
    """For unit vectors: the own cell and the nearest others, ``probes`` in all, as numbers."""
    y = x @ _axes(x.shape[1], t, points) * scale
    own, near, gaps = [], [], []
    k = min(24, probes)
    for b in range(points):
        z = y[:, 8 * b : 8 * b + 8]
        p = decode(z)
        # |z - p - v|^2 - |z - p|^2 = |v|^2 - 2 (z - p).v, and all shortest vectors have norm 2
        gap = 2 - 2 * (z - p) @ _SHORTEST.T
        best = np.argpartition(gap, k - 1, axis=1)[:, :k]
        gap = np.take_along_axis(gap, best, axis=1)
        order = np.argsort(gap, axis=1)
        best, gap = np.take_along_axis(best, order, axis=1), np.take_along_axis(gap, order, axis=1)
        number = _cell(p, t, b)
        others = number[:, None] + _cell(_SHORTEST, t, b)[best]  # cell numbers are linear in the point
        own.append(number)
        near.append(np.concatenate((number[:, None], others), axis=1))
        gaps.append(np.concatenate((np.zeros((len(x), 1)), gap), axis=1))
    number, gap = near[0], gaps[0]
    for more, g in zip(near[1:], gaps[1:], strict=True):
        number = (number[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        gap = (gap[:, :, None] + g[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        number, gap = np.take_along_axis(number, keep, axis=1), np.take_along_axis(gap, keep, axis=1)
    return number[:, :probes]


def _probe(tables: int, probes: int, points: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rep, label = part.column("rep").to_numpy(), part.column("label")
                vectors = part.column("embedding").to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    x = np.array([vectors[i] for i in at])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(tables):
                        c = cells(x, t, points=points, scale=scale, probes=probes)
                        n = c.shape[1]
                        yield pa.record_batch([
                            label.take(pa.array(np.repeat(at, n))), np.full(len(at) * n, dim * 64 + t, dtype=np.int32), c.ravel(), np.repeat(rep[at], n), np.tile(np.arange(n) == 0, len(at)),
                        ], names=["label", "t", "cell", "rep", "own"])

    return run


#: Vectors of a block, on each side.
BLOCK = 2048

MET = "gid long, block int, label string, t int, cell long, rep long, n long, embedding array<double>, probes boolean, owns boolean"


def _compare(least: float, probes: int, points: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each cell's block, the vectors that probe it against those that own it: for each vector how many it links with that no earlier
    table has brought together, copies counted each, as (a, null, count); and links that span the block, as (a, b, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "gid", "block"):
            kinds = list(zip(*(group.column(c).to_pylist() for c in ("label", "t", "cell")), strict=True))
            for kind in set(kinds):  # one, if hashes of cells don't collide
                own = group.filter(pa.array([x == kind for x in kinds])) if kinds.count(kind) < len(kinds) else group
                rep, n = own.column("rep").to_numpy(), own.column("n").to_numpy()
                x = own.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                a, b = (np.flatnonzero(own.column(c).to_numpy()) for c in ("probes", "owns"))
                norm = (x * x).sum(axis=1)
                near = (x[a] @ x[b].T / np.sqrt(norm[a][:, None] * norm[b]) >= least) & (rep[a][:, None] < rep[b])
                if near.any():
                    yield _found(x / np.sqrt(norm)[:, None], rep, n, a, b, near, kind[1] % 64, (probes, points, scale))

    return run


def _found(unit: np.ndarray, rep: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray, t: int, grid: tuple[int, int, float]) -> pa.RecordBatch:
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    a, b, near = a[rows], b[columns], near[np.ix_(rows, columns)]
    probes, points, scale = grid
    first = near.copy()
    for k in range(t):
        looked = cells(unit[a], k, points=points, scale=scale, probes=probes)
        owned = cells(unit[b], k, points=points, scale=scale, probes=1)[:, 0]
        for j in range(looked.shape[1]):
            first &= looked[:, j, None] != owned
    of_a, of_b = first @ n[b], n[a] @ first
    nodes, place = np.unique(np.concatenate((rep[a], rep[b])), return_inverse=True)
    linked = np.zeros((len(nodes), len(nodes)), dtype=bool)
    linked[np.ix_(place[: len(a)], place[len(a) :])] = near
    low, high = spanning(linked | linked.T)
    ends = pa.array([None] * (len(a) + len(b)), pa.int64())
    return pa.record_batch([
        np.concatenate((rep[a], rep[b], nodes[low])), pa.concat_arrays([ends, pa.array(nodes[high], pa.int64())]), np.concatenate((of_a, of_b, np.zeros(len(low), dtype=np.int64))).astype(np.int64),
    ], names=["a", "b", "n"])


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, tables: int = TABLES, probes: int = PROBES, points: int = POINTS, scale: float = SCALE) -> DataFrame:
    """Per row: vec_id, n_links and component_id. The defaults find 0.999 of the pairs at a cosine of 0.98, and more of closer ones."""
    spark = vectors.sparkSession
    ship(spark)
    label = F.col("label") + F.lit(0.0) if dict(vectors.dtypes)[label_col] in ("float", "double") else F.col("label")  # so that -0.0 is 0.0
    own = own_columns(vectors, vec_id=id_col, embedding=vector_col, label=label_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    keyed = own.withColumn("key", F.when(valid, F.xxhash64("label", "embedding")))
    nodes = written(keyed.filter("key IS NOT NULL").groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    rows = written(nodes.select("rep", "label", "embedding").mapInArrow(_probe(tables, probes, points, scale), "label string, t int, cell long, rep long, own boolean"))
    cell = ["label", "t", "cell"]
    shared = rows.groupBy(*cell).agg(F.count("*").alias("looking"), F.sum(F.col("own").cast("int")).alias("owners")).filter("owners > 0 AND looking > 1")
    split = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    met = rows.join(shared.select(*cell, split("looking").alias("of_a"), split("owners").alias("of_b")), cell)
    hashed = F.xxhash64("rep")
    turn = lambda of: F.pmod(hashed, F.col(of)).cast("int")
    # blocks are numbered by the block of those that look and the block of owners; an owner looks too
    sides = F.transform(F.sequence(F.lit(0), F.col("of_b") - 1), lambda j: F.struct((turn("of_a") * F.col("of_b") + j).alias("block"), F.lit(True).alias("probes"), (F.col("own") & (j == turn("of_b"))).alias("owns")))
    other = F.transform(F.filter(F.sequence(F.lit(0), F.col("of_a") - 1), lambda i: F.col("own") & (i != turn("of_a"))), lambda i: F.struct((i * F.col("of_b") + turn("of_b")).alias("block"), F.lit(False).alias("probes"), F.lit(True).alias("owns")))
    met = met.select(F.xxhash64(*cell).alias("gid"), *cell, "rep", F.explode(F.concat(sides, other)).alias("at")).select("gid", *cell, "rep", "at.*")
    met = met.join(nodes.select("rep", "n", "embedding"), "rep").select(*[x.split()[0] for x in MET.split(", ")])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(met.repartition(parts, "gid", "block").sortWithinPartitions("gid", "block").mapInArrow(_compare(least, probes, points, scale), "a long, b long, n long"))
    forget(rows)
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    groups_of = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    of = nodes.join(linked, "rep", "left").join(groups_of, "rep", "left").select("key", "label", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return keyed.join(of, ["key", "label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op2_lattice_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
