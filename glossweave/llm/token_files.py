"""Token files: frequency-ranked ids in a byte-aligned variable-length code, control bytes apart.

Ids are counted over the whole corpus and replaced by their rank, 0 for the most frequent. A rank takes 1 to 4
little-endian bytes in a data stream; its length less one takes 2 bits in a control stream, 4 ranks to a control
byte, lowest bits first. Each document's codes are padded with ranks of 0 to a multiple of 4, so documents can be
coded apart and put in a row. To decode, a table of 256 rows gives each control byte's four lengths, a running sum
the places, and numpy gathers the bytes; a second table turns ranks into ids.

A file set is a folder with two Parquet tables, so that Spark commits them and any store can hold them:
``ranks`` (rank, id) and ``blocks``, one row for each block of documents in ascending doc_id order: part, block,
start_in_part, doc_ids (little-endian 64-bit), lengths (little-endian 32-bit), control, data.

Null and empty texts hold the end id alone. Rows that repeat a doc_id are all written, next to each other, and may be a third of all
rows. Rows without a doc_id come first. A very long text is encoded and coded alone. An empty table makes an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import forget, in_parts, new_path, own_columns, ship, table, written
from glossweave.llm.encode import encoder

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_SHIFTS = np.array([0, 8, 16, 24], dtype=np.uint32)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit ids of all rows of a binary column, and the number of each row's."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]].view("<u2") if raw and at[-1] > at[0] else np.zeros(0, dtype="<u2"), np.diff(at) // 2


def code(ranks: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of documents, of which all ranks come in a row and the number of each."""
    padded = -(-n // 4) * 4
    whole = np.zeros(int(padded.sum()), dtype="<u4")
    whole[np.arange(len(ranks)) + np.repeat(np.cumsum(padded - n) - padded + n, n)] = ranks
    extra = (whole > 0xFF).astype(np.uint8) + (whole > 0xFFFF) + (whole > 0xFFFFFF)
    four = extra.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
    return control, whole.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()


def decode(control: bytes, data: bytes) -> np.ndarray:
    """All ranks, the padding among them."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << _SHIFTS[k]
    return out


ENCODED = "doc_id long, uid long, ids binary, counts binary"


def _encode(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document, and last a row with the counts of all ids."""
    tail = np.array([end_id], dtype="<u2").tobytes()
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path, drops_space=False)
        uid = TaskContext.get().partitionId() << 36
        total = np.zeros(1 << 16, dtype="<i8")
        for part in in_parts(batches, "text", rows=256):
            ids = [x + tail for x in own.encode(part.column("text").to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), dtype="<u2"), minlength=1 << 16)
            yield pa.record_batch([part.column("doc_id"), np.arange(uid, uid + len(ids)), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
            uid += len(ids)
        yield pa.record_batch([pa.array([None], pa.int64()), np.array([uid]), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, dtype="<i8")
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_py(), dtype="<i8")
    ids = np.flatnonzero(total)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])


BLOCKS = "part int, block int, start_in_part long, n_tokens long, doc_ids binary, lengths binary, control binary, data binary"
_BLOCK_TOKENS = 1 << 18
#: Of ids that a part holds, on average; a part is sorted in one task and is one row at the driver.
PART_TOKENS = 1 << 25
_NO_ID = np.iinfo(np.int64).min


def _blocks(rank_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents, in the order of a part, to coded blocks. A part is a task's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, part = rank_of.value, TaskContext.get().partitionId()
        block = start = 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start, held
            doc_ids, ids, n = (np.concatenate(x) for x in zip(*held, strict=True))
            control, data = code(ranks[ids], n)
            row = [part, block, start, len(ids), doc_ids.astype("<i8").tobytes(), n.astype("<u4").tobytes(), control, data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            block, start, held = block + 1, start + len(ids), []
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        size = 0
        for piece in in_parts(batches, "ids", rows=1 << 12, octets=_BLOCK_TOKENS):
            ids, n = flat(piece.column("ids"))
            held.append((piece.column("doc_id").fill_null(_NO_ID).to_numpy(), ids, n))
            size += len(ids)
            if size >= _BLOCK_TOKENS:
                yield close()
                size = 0
        if held:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS) -> None:
    """Writes the file set. Parts are ranges of doc_id of about ``part_tokens`` ids; rows that repeat a doc_id may lie in several."""
    spark = docs.sparkSession
    ship(spark)
    own = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    encoded = written(own.mapInArrow(_encode(tokenizer, end_id), ENCODED))
    counts = encoded.filter("counts IS NOT NULL").select("counts").mapInArrow(_sum, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary at most
    ids = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    rank_of = np.zeros(1 << 16, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(ids)), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in counts) // part_tokens))
    dealt = encoded.filter("ids IS NOT NULL").select("doc_id", "uid", "ids").repartitionByRange(parts, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    dealt.mapInArrow(_blocks(spark.sparkContext.broadcast(rank_of)), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    forget(encoded)


def _read(starts, id_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids = starts.value, id_of.value
        for batch in batches:
            for r in batch.to_pylist():
                tokens = ids[decode(r["control"], r["data"])]
                n = np.frombuffer(r["lengths"], dtype="<u4").astype(np.int64)
                padded = -(-n // 4) * 4
                at = np.cumsum(padded) - padded
                doc_ids = np.frombuffer(r["doc_ids"], dtype="<i8")
                start = first[r["part"]] + r["start_in_part"] + np.cumsum(n) - n
                crc = [zlib.crc32(tokens[a : a + k].tobytes()) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch([pa.array(doc_ids, mask=doc_ids == _NO_ID), start, n, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def _tables(spark: SparkSession, path: str):
    id_of = np.array([r["id"] for r in sorted(spark.read.parquet(f"{path}/ranks").collect())] or [0], dtype="<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toArrow()  # a row for each part
    starts = np.zeros(max([0, *sizes.column("part").to_pylist()]) + 2, dtype=np.int64)
    starts[sizes.column("part").to_numpy() + 1] = sizes.column("n").to_numpy()
    return blocks, spark.sparkContext.broadcast(np.cumsum(starts)), spark.sparkContext.broadcast(id_of)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids as 32-bit integers."""
    ship(spark)
    blocks, starts, id_of = _tables(spark, path)
    return blocks.mapInArrow(_read(starts, id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(id_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = id_of.value
        for batch in batches:
            for r in batch.to_pylist():
                tokens = ids[decode(r["control"], r["data"])].astype(np.int32)
                n = np.frombuffer(r["lengths"], dtype="<u4").astype(np.int64)
                padded = -(-n // 4) * 4
                at = np.cumsum(padded) - padded
                doc_ids = np.frombuffer(r["doc_ids"], dtype="<i8")
                yield pa.record_batch([pa.array(doc_ids, mask=doc_ids == _NO_ID), pa.array([tokens[a : a + k] for a, k in zip(at.tolist(), n.tolist(), strict=True)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id and all its ids."""
    ship(spark)
    blocks, _, id_of = _tables(spark, path)
    return blocks.mapInArrow(_ids(id_of), "doc_id long, ids array<int>")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path)
