"""Near-duplicate texts by the similarity of their shingle sets, over SimHash fingerprints.

Pivot tables (``simhash.links``) bring together all fingerprints within 2 bits, none left out, and those that other links leave in different groups are verified.
Fingerprints of texts at a similarity of 0.8 lie 10 bits apart on average and up to 20, where pivot coordinates
discard nearly nothing. So texts meet by shared least shingles too: ``BANDS`` keys of ``ROWS`` least hashes each. A pair
at 0.8 has no key in common but once in 5,500. Pairs at more than ``FAR`` differing bits are discarded; for a pair at 0.8 that
happens once in 5,000,000, and with four and five shingles, the worst case, once in 75,000. Survivors are verified on their whole sets, exactly.

Texts with equal sets are one node. First each node meets, of each of its keys, the node that meets most others, and
all that meet the same one are compared. Then, within a key, nodes meet that this left in different groups. Both times the nodes
that meet are cut into blocks by number and size, so a hot key costs no task more than a block or a pair of blocks. A
task counts the common shingles of its nodes and gives only links that span its groups: rows stay linear in the nodes
of a block, and no pair is left out.

Null and empty texts have no shingles and are alike; texts shorter than a shingle are one shingle. Rows that repeat a
doc_id are one document: it is linked by each of its texts, and its rows stay or go together. Rows without a doc_id link
nothing. Very long texts are blocks of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import forget, groups, in_parts, own_columns, ship, written
from glossweave.llm.components import components, spanning
from glossweave.llm.simhash import fingerprints, links, shingle_hashes

BANDS, ROWS, FAR = 12, 3, 26
#: Nodes and shingles of a block.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 19
#: Bytes of text that a task verifies, on average; in a shuffle repeated texts look far smaller than they are.
VERIFY_BYTES = 16 << 20
_A = np.random.default_rng(13).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(17).integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.tobytes())


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of which two texts share each with the third power of their shingle sets' similarity."""
    if not len(shingles):
        return np.zeros(BANDS, dtype=np.int64)
    h = shingles ^ shingles >> np.uint64(31)
    least = np.min([(x * _A + _B).min(axis=1) for x in np.split(h, range(4096, len(h), 4096))], axis=0)
    return ((least.reshape(BANDS, ROWS) * _A.reshape(BANDS, ROWS)).sum(axis=1, dtype=np.uint64) + _B[:BANDS, 0]).view(np.int64)


SKETCH = "doc_id long, name binary, fp long, size long, bands array<long>, octets long"


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches, "text", rows=64):
            sets = [shingle_set(t.as_py(), size) for t in part.column("text").cast(pa.binary())]
            columns = [
                part.column("doc_id"), pa.array(map(set_name, sets), pa.binary()), fingerprints(sets), pa.array(map(len, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64())),
                pc.fill_null(pc.binary_length(part.column("text")).cast(pa.int64()), 0),
            ]
            yield pa.record_batch(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common (of sets without repeats)."""
    m = len(sets)
    total = np.zeros(m * m, dtype=np.float64)
    whole = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1]))) if len(whole) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(first, len(whole)))
    few = 48
    for k in range(2, few):  # elements of k sets: their pairs one by one
        for at in np.array_split(own := first[n == k], max(1, len(own) * k * k >> 22)):
            sets_of = owner[at[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            total += np.bincount((sets_of[:, i] * m + sets_of[:, j]).ravel(), minlength=m * m)
    total = total.reshape(m, m)
    total += total.T
    many, times = first[n >= few], n[n >= few]
    for k in range(0, len(many), 2048):  # of many sets: a product of matrices
        at, t = many[k : k + 2048], times[k : k + 2048]
        one = np.zeros((m, len(at)), dtype=np.float32)
        one[owner[np.arange(t.sum()) + np.repeat(at - np.cumsum(t) + t, t)], np.repeat(np.arange(len(at)), t)] = 1
        total += one @ one.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _verify(size: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "gid", "block"):
            sets = [shingle_set(t.as_py(), size) for t in group.column("text").cast(pa.binary())]
            # a doc_id may have other texts than the node's
            own = [k for k, (s, name) in enumerate(zip(sets, group.column("name").to_pylist(), strict=True)) if set_name(s) == name]
            if len(own) < 2:
                continue
            sets, rep = [sets[k] for k in own], group.column("rep").to_numpy()[own]
            both, n = common(sets), np.array([len(s) for s in sets], dtype=float)
            a, b = spanning(both >= least * (n[:, None] + n - both))
            yield pa.record_batch([rep[a], rep[b]], names=["a", "b"])

    return run


MEET = "gid long, block int, rep long, name binary, octets long"


def _meeting(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of two blocks of a key, the nodes with anyone to be compared with: of another group, near in size and fingerprint, and
    without an earlier key in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "gid", "block"):
            of, fp, size = t.column("group").to_numpy(), t.column("fp").to_numpy(), t.column("size").to_numpy()
            bands, band, own = np.array(t.column("bands").to_pylist()), t.column("band")[0].as_py(), t.column("own").to_numpy()
            meet = of[:, None] != of
            if len(set(own.tolist())) > 1:
                meet &= own[:, None] != own
            meet &= np.minimum(size[:, None], size) >= least * np.maximum(size[:, None], size)
            meet &= np.bitwise_count((fp[:, None] ^ fp).view(np.uint64)) <= FAR
            for k in range(band):
                meet &= bands[:, None, k] != bands[:, k]
            yield from t.select([x.split()[0] for x in MEET.split(", ")]).filter(pa.array(meet.any(axis=1))).to_batches()

    return run


def _blocks(nodes: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with rep and size) with ``block``, the part of their key that they are in."""
    blocks = rows.groupBy(key).agg(_blocks(F.count("*"), F.sum("size")).alias("__blocks"))
    return rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("__blocks")).cast("int")).drop("__blocks")


def _across_groups(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (with rep, size and group) as often as the pairs of blocks of their key need them: with ``block``, which numbers those, and ``own``, the row's own block.

    The largest group of a key has blocks of its own, and they meet the others' blocks only: its nodes need no comparison with each other. A
    large group beside a few strangers is so many rows as it has nodes."""
    each = rows.groupBy(key, "group").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    top = each.groupBy(key).agg(F.max(F.struct("n", "group")).alias("top"))
    large = F.col("group") == F.col("top.group")
    part = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    blocks = each.join(top, key).groupBy(key).agg(F.first("top.group").alias("__large"), _blocks(part("n", large), part("s", large)).alias("__a"), _blocks(part("n", ~large), part("s", ~large)).alias("__b"))
    dealt = rows.join(blocks, key).withColumn("own", F.when(F.col("group") == F.col("__large"), F.pmod(F.xxhash64("rep"), F.col("__a"))).otherwise(F.col("__a") + F.pmod(F.xxhash64("rep"), F.col("__b"))).cast("int"))
    all_ = F.col("__a") + F.col("__b")
    first = F.when(F.col("own") < F.col("__a"), F.col("__a")).otherwise(F.lit(0))
    other = F.transform(F.sequence(first, all_ - 1), lambda x: F.least(x, "own") * all_ + F.greatest(x, "own"))
    return dealt.withColumn("block", F.explode(other)).drop("__large", "__a", "__b")


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b): all fingerprints of ``nodes`` (fp) within 2 bits, by pivot tables, and with a = b those of several nodes."""
    each = nodes.groupBy("fp").agg(F.count("*").alias("n"))
    return links(each.select("fp", F.col("fp").alias("rep"))).unionByName(each.filter("n > 1").select(F.col("fp").alias("a"), F.col("fp").alias("b")))


def close_strangers(nodes: DataFrame, close: DataFrame) -> DataFrame:
    """``nodes`` (with fp and group) that a pair of ``close`` brings to a node of another group: with ``gid``, in which they meet. Pairs of groups are made first, so
    a large group of near copies, of which each is close to many, gives no rows."""
    groups_ = nodes.select("fp", "group").distinct()
    side = lambda c: groups_.select(F.col("fp").alias(c), F.col("group").alias(f"{c}_group"))
    apart = close.join(side("a"), "a").join(side("b"), "b").filter("a_group <> b_group AND (a <> b OR a_group < b_group)")
    both = F.array(*[F.struct(F.col(c).alias("fp"), F.col(f"{c}_group").alias("group")) for c in ("a", "b")])
    return apart.select(F.xxhash64("a", "a_group", "b", "b_group").alias("gid"), F.explode(both).alias("x")).select("gid", "x.*").join(nodes, ["fp", "group"])


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(node, component): the doc_ids that links of ``least`` or more lead to another, and the least doc_id of their group."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL")
    prints = written(own.mapInArrow(_sketch(words), SKETCH))
    nodes = written(prints.groupBy("name").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("fp", "size", "bands", "octets")]))
    copies = written(prints.join(nodes.select("name", "rep"), "name").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    forget(prints)

    def verified(met: DataFrame) -> DataFrame:
        """Links of all pairs of nodes (rep, name, octets) that have gid and block in common."""
        met = written(met)
        octets = met.agg(F.sum("octets").alias("n")).first()["n"] or 0
        tasks = max(parts, -(-octets // VERIFY_BYTES))
        rows = texts.join(met.withColumnRenamed("rep", "doc_id"), "doc_id").select("gid", "block", F.col("doc_id").alias("rep"), "name", "text")
        found = written(rows.repartition(tasks, "gid", "block").sortWithinPartitions("gid", "block").mapInArrow(_verify(words, least), "a long, b long"))
        forget(met)
        return found

    node = ["rep", "name", "size", "octets"]
    packed = nodes.select(*node, F.posexplode("bands").alias("band", "key"))
    shared = packed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(packed.join(shared, "key"))
    close = written(close_fingerprints(nodes))
    by_pivots = nodes.join(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi").select("rep")
    # whole texts are shuffled this once, and only those that meet others are kept
    texts = written(own.join(live.select("rep").unionByName(by_pivots).select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    known = live.groupBy("rep").agg(F.sum("n").alias("met"))
    lead = live.join(known, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"), *node)).alias("top")).select("key", "top.*")
    led = live.join(lead.select("key", F.col("rep").alias("gid"), F.col("size").alias("lead_size")), "key")
    led = led.filter((F.col("rep") != F.col("gid")) & (F.least("size", "lead_size") >= least * F.greatest("size", "lead_size"))).select("gid", *node).distinct()
    led = written(_in_blocks(led, "gid").select("gid", "block", "rep", "name", "octets"))
    leaders = led.select("gid", "block").distinct().join(lead.select("rep", "name", "octets").distinct(), F.col("gid") == F.col("rep"))
    first = verified(led.unionByName(leaders))
    forget(led)

    found = written(components(first).withColumnRenamed("node", "rep"))
    in_groups = lambda df: df.join(found, "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("component", "n")
    grouped = written(in_groups(live))
    forget(live)
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
    rest = grouped.join(open_keys, "key").join(nodes.select("rep", "name", "fp", "bands"), ["rep", "name"]).withColumnRenamed("key", "gid")
    meeting = _across_groups(rest, "gid").repartition(parts, "gid", "block").sortWithinPartitions("gid", "block")
    strangers = _across_groups(close_strangers(in_groups(nodes.select("fp", *node)), close), "gid").select(*[x.split()[0] for x in MEET.split(", ")])
    second = verified(meeting.mapInArrow(_meeting(least), MEET).unionByName(strangers))
    forget(grouped, nodes, texts, close, found)
    found = components(copies.unionByName(first).unionByName(second))
    forget(first, second, copies)
    return found


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with its columns; of each group of near-duplicates only the least doc_id's rows stay. Rows without an id stay."""
    gone = similar_components(docs, id_col=id_col, text_col=text_col, words=words, least=least).filter("node <> component").select(F.col("node").alias("__gone"))
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
