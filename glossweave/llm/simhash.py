"""SimHash near-dedup with pivot distance tables.

A fingerprint's Hamming distances to ``PIVOTS`` fixed reference fingerprints are computed once, for each of four 16-bit
blocks. By the triangle inequality two fingerprints at distance r differ by r at most in every pivot coordinate;
the same holds for the distances within a block. Two fingerprints at distance 2 or less agree in at least two blocks,
so there all block coordinates are equal: the table is keyed by the coordinates of each pair of blocks, six keys a
fingerprint, and a key join brings every such pair together. The pairs are discarded by their largest coordinate
difference over whole fingerprints, and survivors are verified. Whole-fingerprint coordinates alone can't key
a join: of two random fingerprints a third agree within 2 in any one of them, as they spread by a few bits only.

Equal fingerprints are one node with their least id, so copies are never paired; a fingerprint has at most
2,080 others within 2 bits, which bounds the links per node. Components are found by minima and joins. Very long texts are
hashed one by one.

Null and empty texts have no words and fingerprint zero, and link like any other. Texts shorter than a
shingle are one shingle. Repeated rows fall into one group. An empty table gives no rows. Rows without an id link
nothing and name no component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import forget, in_parts, own_columns, ship, table, written
from glossweave.llm.components import components

PIVOTS = 12
_BLOCKS = 4
_REFERENCE = [int(x) for x in np.random.default_rng(11).integers(-(1 << 63), 1 << 63, PIVOTS, dtype=np.int64)]
_MASKS = [(0xFFFF << 16 * b) - (1 << 64 if b == 3 else 0) for b in range(_BLOCKS)]
_TABLES = list(combinations(range(_BLOCKS), 2))


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[: -size + 1 or None] - [len(w) + 1 for w in words[: len(words) - size + 1]]).tolist()
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints(hashes: list) -> np.ndarray:
    """One for each list or array: a bit is 1 if it is set in over half the hashes; 0 for no hashes."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = [k for k, h in enumerate(hashes) if len(h)]
    if full:
        n = np.array([len(hashes[k]) for k in full])
        if n.sum() <= _AT_ONCE:
            sums = np.add.reduceat(_bits(np.concatenate([np.asarray(hashes[k], dtype=np.uint64) for k in full])), np.cumsum(n) - n, axis=0, dtype=np.int32)
        else:
            sums = np.array([sum(_bits(np.asarray(hashes[k][x : x + _AT_ONCE], dtype=np.uint64)).sum(axis=0, dtype=np.int64) for x in range(0, len(hashes[k]), _AT_ONCE)) for k in full])
        out[full] = np.packbits(2 * sums > n[:, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


#: Hashes whose bits are in memory at once.
_AT_ONCE = 1 << 18


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def _fingerprint(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "text", rows=64):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            yield pa.record_batch([part.column("doc_id"), fingerprints([shingle_hashes(t, size) for t in texts])], names=["doc_id", "fp"])

    return run


def _coordinate(fp: Column, pivot: int, block: int | None = None) -> Column:
    apart = fp.bitwiseXOR(F.lit(_REFERENCE[pivot]))
    return F.bit_count(apart if block is None else apart.bitwiseAND(F.lit(_MASKS[block]))).cast("long")


def pivot_table(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, rep) with ``blocks``, each block's coordinates, and ``whole``, eight whole coordinates, packed in longs."""
    fp = F.col("fp")
    blocks = [sum((F.shiftleft(_coordinate(fp, j, b), 5 * j) for j in range(1, PIVOTS)), _coordinate(fp, 0, b)) for b in range(_BLOCKS)]
    whole = sum((F.shiftleft(_coordinate(fp, j), 8 * j) for j in range(1, 8)), _coordinate(fp, 0))
    return nodes.select("fp", "rep", F.array(*blocks).alias("blocks"), whole.alias("whole"))


def _close(a: str, b: str, bits: int) -> Column:
    """The largest coordinate difference and then the distance are within ``bits``."""
    left, right = F.col(f"{a}.whole"), F.col(f"{b}.whole")
    part = lambda x, j: F.shiftright(x, 8 * j).bitwiseAND(F.lit(255))
    near = F.abs(part(left, 0) - part(right, 0)) <= bits
    for j in range(1, 8):
        near &= F.abs(part(left, j) - part(right, j)) <= bits
    return near & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= bits)


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the reps of all fingerprints within 2 bits, each once."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.col("blocks")[x], F.col("blocks")[y]).alias("key")) for t, (x, y) in enumerate(_TABLES)])
    rows = pivot_table(nodes).select("fp", "rep", "whole", F.explode(keys).alias("at")).select("fp", "rep", "whole", "at.t", "at.key")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    same = [apart.bitwiseAND(F.lit(m)) == 0 for m in _MASKS]
    first = F.coalesce(*[F.when(same[x] & same[y], F.lit(t)) for t, (x, y) in enumerate(_TABLES)])
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _close("a", "b", 2) & (first == F.col("a.t"))
    return rows.alias("a").join(rows.alias("b"), on).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Per row: doc_id, fp (as a signed long) and component_id, the least id that links of 2 bits or fewer lead to."""
    ship(docs.sparkSession)
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = written(own.mapInArrow(_fingerprint(words), "doc_id long, fp long"))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(nodes.filter("rep IS NOT NULL")))
    of = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
