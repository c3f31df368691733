"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words go into one suffix automaton. Each task streams the words of its documents through it; at
every word the automaton knows the longest item passage that ends there. A passage of ``window`` words or more,
or a whole item shorter than that, is a leak and its words are hit.

The items are broadcast, so they are measured first and cut into shards of about ``shard_bytes`` of text. Each shard
gets its own pass, whose tasks build its automaton, and the spans of all passes are united per row: with several shards
every row gets a key of its own first, so ids may repeat or be null. The number of shards doesn't change results.

Null and empty texts have no words; items without words match nothing; rows that repeat an item's id are one item; items
without an id hit words but aren't listed. Ids of items may be of any type and are listed as strings. Very long texts pass through word by
word. An empty table of items hits nothing, and ``remove_leaks`` then returns all rows as they are. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import own_columns, ship, table, written

#: Bytes that separate words become spaces, A-Z become a-z; digits, a-z and all beyond ASCII stay.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SPANS = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
#: Of item text in a shard. An automaton of 2 MB takes up to 200 MB of a Python worker, measured on text without repeats.
SHARD_BYTES = 2 << 20


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


class Automaton:
    """States are numbered; 0 is the root. ``window_items[s]``: items that hold the window ending in state s."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        self.least = window
        for item, text in items:
            last = 0
            for n, w in enumerate(text, 1):
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                if n >= window:
                    ends.setdefault(last, set()).add(item)
        for item, text in items:
            if 0 < len(text) < window:
                self.least = min(self.least, len(text))
                at = 0
                for w in text:
                    at = self.next[at][self.ids[w]]
                short.setdefault(at, {}).setdefault(len(text), set()).add(item)
        # an item that ends in a state also ends in the states its suffix links lead to
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if s in ends and self.link[s] > 0:
                ends.setdefault(self.link[s], set()).update(ends[s])
        self.of_window: list[int] = [0] * len(self.link)
        self.window_items: dict[int, tuple] = {}
        self.short: list[tuple[tuple[int, tuple], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[up] >= window:
                self.of_window[s] = self.of_window[up]
            elif self.length[s] >= window:
                self.of_window[s] = s
                self.window_items[s] = tuple(ends.get(s, ()))
            self.short[s] = self.short[up] + tuple((k, tuple(v)) for k, v in short.get(s, {}).items())

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            old = nxt[last][w]
            return old if length[old] == length[last] + 1 else self._split(last, w, old)
        new = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def spans(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """First and last word of each stretch of hit words, in order and apart; and the items found."""
        got: list[tuple[int, int]] = []
        found: set = set()
        seen: set[int] = set()
        if not self.ids or len(text) < self.least:
            return got, found
        at = np.array([self.ids.get(w, -1) for w in text], dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], at >= 0, [False]))))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in edges.reshape(-1, 2):
            if b - a < self.least:  # a word that no item has stands between
                continue
            s = n = 0
            for i, w in enumerate(at[a:b].tolist(), int(a)):
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if w in nxt[s]:
                    s, n = nxt[s][w], n + 1
                reach = 0
                if n >= window:
                    reach = window
                    seen.add(self.of_window[s])
                for k, items in self.short[s]:
                    if k <= n:
                        reach = max(reach, k)
                        found.update(items)
                if reach:
                    first = i - reach + 1
                    while got and got[-1][1] >= first - 1:
                        first = min(first, got.pop()[0])
                    got.append((first, i))
        for s in seen:
            found.update(self.window_items[s])
        return got, found


#: The shard that this Python worker has built last, and its automaton.
_LAST: list = [None, None]


def _built(shared) -> Automaton:
    items, window = shared.value
    if _LAST[0] is not items:
        _LAST[:] = [None, None]  # one automaton in memory
        _LAST[:] = [items, Automaton([(item, words(text.encode())) for item, text in items], window)]
    return _LAST[1]


def _shards(benchmark: DataFrame, *, item_col: str, item_text_col: str, window: int, shard_bytes: int) -> list:
    """Broadcasts of the items' texts, with the window. A shard holds ``shard_bytes`` on average, or one longer item."""
    items = own_columns(benchmark, item=item_col, text=item_text_col).withColumn("item", F.col("item").cast("string"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = -(-size // shard_bytes) or 1
    out = []
    for k in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
        out.append(benchmark.sparkSession.sparkContext.broadcast(([(r["item"], r["text"]) for r in own.orderBy("item", "text").collect() if r["text"]], window)))
    return out


_LIST = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _built(shared)
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = words(text)
                got, found = a.spans(text)
                n.append(len(text))
                spans.append([{"first": x, "last": y} for x, y in got])
                items.append(sorted(x for x in found if x is not None))
            names = [c for c in batch.schema.names if c != "text"]
            found = [pa.array(n, pa.int64()), pa.array(spans, _LIST), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*(batch.column(c) for c in names), *found], names=[*names, "n_words", "spans", "items"])

    return scan


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several passes over one document become stretches apart."""
    for batch in batches:
        spans = []
        for row in batch.column("spans").to_pylist():
            got: list[dict] = []
            for x in sorted(row, key=lambda x: (x["first"], x["last"])):
                if got and x["first"] <= got[-1]["last"] + 1:
                    got[-1]["last"] = max(got[-1]["last"], x["last"])
                else:
                    got.append(dict(x))
            spans.append(got)
        yield batch.set_column(batch.schema.get_field_index("spans"), batch.schema.field("spans"), pa.array(spans, batch.schema.field("spans").type))


def leak_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: its words, its hit stretches (numbers of first and last word) and the items found in it."""
    spark = docs.sparkSession
    ship(spark)
    docs = own_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = _shards(benchmark, item_col=item_col, item_text_col=item_text_col, window=window, shard_bytes=shard_bytes)
    if len(shards) == 1:
        return docs.mapInArrow(_scan(shards[0]), SPANS)
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    first, *rest = [keyed.mapInArrow(_scan(s), f"key long, {SPANS}") for s in shards]
    for more in rest:
        first = first.unionByName(more.filter("size(spans) > 0"))
    return (
        first.groupBy("key", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("key")
        .mapInArrow(_unite, SPANS)
    )


def _cut(shared, max_coverage: float):
    """Of rows with ``__spans``, those are cut; of others, what ``shared`` finds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _built(shared) if shared else None
        for batch in batches:
            texts, keep = [], []
            own = batch.column("text").to_pylist()
            given = [None] * len(own) if a else batch.column("__spans").to_pylist()
            for text, spans in zip(own, given, strict=True):
                raw = text.encode() if text else b""
                at = words(raw)
                spans = a.spans(at)[0] if a else [(x["first"], x["last"]) for x in spans or ()]
                clean, kept = _without(text, raw, len(at), spans, max_coverage)
                texts.append(clean)
                keep.append(kept)
            batch = batch if a else batch.drop_columns(["__spans"])
            batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return cut


def _without(text: str | None, raw: bytes, n_words: int, spans: list[tuple[int, int]], max_coverage: float) -> tuple[str | None, bool]:
    """The text without the characters from a stretch's first word to its last; and whether enough of it was clean."""
    if not spans:
        return text, True
    if sum(y - x + 1 for x, y in spans) > max_coverage * n_words:
        return text, False
    at = np.frombuffer(raw.translate(_BYTES), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], at, [False])))).reshape(-1, 2)
    out, done = [], 0
    for x, y in spans:
        out.append(raw[done : edges[x][0]])
        done = edges[y][1]
    return b"".join([*out, raw[done:]]).decode(), True


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_coverage: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with its columns, leaked stretches cut out of the text; documents with more than ``max_coverage`` of their words leaked go."""
    ship(docs.sparkSession)
    shards = _shards(benchmark, item_col=item_col, item_text_col=item_text_col, window=window, shard_bytes=shard_bytes)
    renamed = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    if len(shards) == 1:
        out = renamed.mapInArrow(_cut(shards[0], max_coverage), renamed.schema)
    else:
        keyed = written(renamed.select(F.monotonically_increasing_id().alias("key"), F.struct(*renamed.columns).alias("row")))
        texts = keyed.select("key", "row.text")
        first, *rest = [texts.mapInArrow(_scan(s), "key long, n_words long, spans array<struct<first:long,last:long>>, items array<string>").filter("size(spans) > 0").select("key", "spans") for s in shards]
        for more in rest:
            first = first.unionByName(more)
        hits = first.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_unite, "key long, spans array<struct<first:long,last:long>>")
        both = keyed.join(hits, "key", "left").select("row.*", F.col("spans").alias("__spans"))
        out = both.mapInArrow(_cut(None, max_coverage), renamed.schema)
    return out.withColumnRenamed("text", text_col) if text_col != "text" else out


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    names = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
