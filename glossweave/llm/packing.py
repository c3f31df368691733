"""Vector bin packing of examples into training sequences by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens. Examples longer than a sequence give
full pieces first; what is left of each is an item with a demand in each dimension. A block of items is packed at
a time: the sequence being filled takes, of all items that still fit, the one whose demand has the largest dot
product with the room that is left (both as shares of the limits, dimensions weighed by how scarce they are in the
block); when none fits, the next sequence opens with the largest item. Items of equal demand are one entry with a
count, so a block with many equal items costs no more than one with few.

Blocks follow the rows of a partition, so packing needs no shuffle, and memory is bounded by ``block_items``.
Sequence ids are the partition's number times 2**32 plus a running number, so they differ between partitions.

Null and empty texts hold the end id alone; an empty table gives no pieces; repeated rows are packed each. Very long texts are
encoded whole and cut into full pieces. Examples of equal demand are taken in the order of their rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import in_parts, own_columns, ship, table
from glossweave.llm.encode import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, loss_tokens long"


def pack(demands: np.ndarray, limits: tuple[int, ...]) -> list[list[int]]:
    """Rows of ``demands`` (all within ``limits``) to sequences, each a list of row numbers."""
    if not len(demands):
        return []
    kinds, which = np.unique(demands, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    ends = np.cumsum(left)  # the rows of kind k yet to place are order[ends[k] - left[k] : ends[k]]
    share = kinds / np.array(limits, dtype=float)
    weight = (share * left[:, None]).sum(axis=0)
    weighed = share * (weight / weight.sum()) if weight.sum() else share
    room = np.array(limits, dtype=np.int64)
    out: list[list[int]] = [[]]
    todo = len(demands)
    while todo:
        fits = np.flatnonzero((left > 0) & (kinds <= room).all(axis=1))
        if not len(fits):
            out.append([])
            room = np.array(limits, dtype=np.int64)
            continue
        k = fits[np.argmax(weighed[fits] @ (room / limits))]
        out[-1].append(int(order[ends[k] - left[k]]))
        left[k] -= 1
        todo -= 1
        room -= kinds[k]
    return out


def _pieces(path: str, drops_space: bool, end_id: int, max_tokens: int, max_segments: int, max_loss: int, block_items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path, drops_space=drops_space)
        tail = np.array([end_id], dtype="<u2").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        items: list[tuple] = []
        loss: list[int] = []

        def place() -> pa.RecordBatch:
            nonlocal sequence
            demands = np.array([(x[2], 1, n) for x, n in zip(items, loss, strict=True)], dtype=np.int64).reshape(-1, 3)
            rows = []
            for members in pack(demands, (max_tokens, max_segments, max_loss)):
                offset = 0
                for n, k in enumerate(members):
                    rows.append((*items[k], sequence, offset, n, loss[k]))
                    offset += items[k][2]
                sequence += bool(members)
            items.clear()
            loss.clear()
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names=names)

        for part in in_parts(batches, "text", rows=256):
            texts, prompts = own.encode(part.column("text").to_pylist()), own.encode(part.column("prompt").to_pylist())
            for doc, prompt, ids in zip(part.column("doc_id").to_pylist(), prompts, texts, strict=True):
                ids = np.frombuffer(prompt + ids + tail, dtype="<u2").astype("<u4")
                bears = max(1, len(prompt) // 2)  # from there on
                start = 0
                while start < len(ids):
                    length = min(max_tokens, max(0, bears - start) + max_loss, len(ids) - start)
                    items.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    loss.append(max(0, start + length - max(start, bears)))
                    start += length
            if len(items) >= block_items:
                yield place()
        yield place()

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str, end_id: int, drops_space: bool, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, block_items: int = 4096) -> DataFrame:
    """One row per piece. ``prompt_col``: text before the other, whose tokens bear no loss, nor does a document's first
    token, which nothing precedes; all others do, and ``max_loss`` (1 or more) of them at most stand in a sequence."""
    ship(docs.sparkSession)
    columns = {"doc_id": id_col, "text": text_col} | ({"prompt": prompt_col} if prompt_col else {})
    own = own_columns(docs, **columns).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = own if prompt_col else own.withColumn("prompt", F.lit(None).cast("string"))
    return own.mapInArrow(_pieces(tokenizer, drops_space, end_id, max_tokens, max_segments, max_loss, block_items), PIECES)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, drops_space=True)
