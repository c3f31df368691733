"""Many terms looked for in all texts at once, by an automaton of the terms.

The terms are measured and cut into shards by their first character; each shard is broadcast, and its tasks build an Aho-Corasick automaton of it once
for each worker and read every text once. What comes out is a row for each text and term that meet, with the columns asked for: no text is copied to its words, and none is
shuffled for the sake of a match. Beyond ``most_chars`` of terms the terms are joined by an index key instead, also without texts in the rows that spread.

``how`` a term may stand in a text:
* ``term``: terms with Han characters anywhere as they are; others whatever their case, not next to an ASCII letter, digit or underscore;
* ``exact``: anywhere, as it is written;
* ``lower``: anywhere, whatever its case.

Terms are taken without white space at their ends (``term`` and ``lower``); null and blank ones match nothing, nor does anything match in a null text. Terms that are equal meet a text each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.operators.numbering import kept
from glossweave.shipping import ship

#: Of terms in a shard, and in all shards: an automaton takes some 60 bytes for each character.
SHARD_CHARS, MOST_CHARS = 1 << 20, 1 << 24
#: Rows given out at once.
_ROWS = 1 << 12

_HAN = re.compile("[一-鿿]")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _plain(c: str) -> str:
    """One character whatever its case: of its capital's small form, if these are single characters."""
    big = c.upper()
    return (big if len(big) == 1 else c).lower()[0]


class _Folds(dict):
    def __missing__(self, c: int) -> str:
        self[c] = out = _plain(chr(c))
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """As long as the text, and equal for texts that differ in case only."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


class Terms:
    """Terms by their folded forms in an automaton."""

    def __init__(self, terms: list[str | None], how: str):
        self.how = how
        self.terms = [(t or "") if how == "exact" else (t or "").strip() for t in terms]
        self.as_written = [how == "exact" or how == "term" and bool(_HAN.search(t)) for t in self.terms]
        at: dict[str, list[int]] = {}
        for k, t in enumerate(self.terms):
            if t:
                at.setdefault(fold(t), []).append(k)
        self.found = ahocorasick.Automaton()
        for folded, own in at.items():
            self.found.add_word(folded, (len(folded), own))
        if at:
            self.found.make_automaton()
        self.any = bool(at)

    def matches(self, text: str) -> dict[int, list[int]]:
        """Where each term that the text holds begins."""
        out: dict[int, list[int]] = {}
        if not self.any:
            return out
        low = fold(text)
        last = len(low) - 1
        bounded = self.how == "term"
        for end, (n, own) in self.found.iter(low):
            start = end - n + 1
            free = not bounded or (start == 0 or low[start - 1] not in _WORD) and (end == last or low[end + 1] not in _WORD)
            for k in own:
                if text.startswith(self.terms[k], start) if self.as_written[k] else free:
                    out.setdefault(k, []).append(start)
        return out


#: The shard that this worker has built last, and its automaton.
_LAST: list = [None, None, None]


def _built(shared) -> tuple[pa.Table, Terms]:
    given = shared.value
    if _LAST[0] is not given:
        raw, column, how = given
        table = pa.ipc.open_stream(raw).read_all().combine_chunks()
        _LAST[:] = [given, table, Terms(table.column(column).to_pylist(), how)]
    return _LAST[1], _LAST[2]


def _meet(shared, text: str, columns: list[str], own: list[str], positions: str | None):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, terms = _built(shared)
        names = [*columns, *own, *([positions] if positions else [])]

        def given(batch: pa.RecordBatch, rows: list[int], ids: list[int], starts: list[list[int]]) -> pa.RecordBatch:
            left, right = batch.take(pa.array(rows, pa.int64())), table.take(pa.array(ids, pa.int64())).combine_chunks()
            out = [*(left.column(c) for c in columns), *((right.column(c).chunk(0) if right.num_rows else pa.array([], right.schema.field(c).type)) for c in own)]
            return pa.record_batch([*out, *([pa.array(starts, pa.list_(pa.int32()))] if positions else [])], names=names)

        for batch in batches:
            rows: list[int] = []
            ids: list[int] = []
            starts: list[list[int]] = []
            for k, x in enumerate(batch.column(text).to_pylist()):
                if x:
                    for t, at in terms.matches(x).items():
                        rows.append(k)
                        ids.append(t)
                        starts.append(at)
                if len(rows) >= _ROWS:
                    yield given(batch, rows, ids, starts)
                    rows, ids, starts = [], [], []
            if rows:
                yield given(batch, rows, ids, starts)

    return meet


def _first(term: str) -> Column:
    return F.lower(F.substring(F.trim(term), 1, 1))


def _sizes(terms: DataFrame, term: str) -> dict[str | None, int]:
    """Characters of the terms, by their first one."""
    return {r["first"]: r["chars"] for r in terms.groupBy(_first(term).alias("first")).agg(F.sum(F.coalesce(F.length(term), F.lit(0)) + 1).alias("chars")).collect()}


def _shards(terms: DataFrame, term: str, how: str, sizes: dict[str | None, int], shard_chars: int) -> list:
    """Broadcasts of the terms' rows. Terms with one first character are cut further if they are many."""
    context = terms.sparkSession.sparkContext
    first = _first(term)
    out = []
    room, group = 0, []
    groups: list[tuple[list, int]] = []
    for c in sorted(sizes, key=lambda c: c or ""):
        if room + sizes[c] > shard_chars and group:
            groups.append((group, 1))
            room, group = 0, []
        if sizes[c] > shard_chars:
            groups.append(([c], -(-sizes[c] // shard_chars)))
            continue
        room, group = room + sizes[c], [*group, c]
    if group:
        groups.append((group, 1))
    whole = len(groups) == 1 and groups[0][1] == 1
    for letters, parts in groups:
        own = terms if whole else terms.filter(first.isin([c for c in letters if c is not None]) | (first.isNull() if None in letters else F.lit(False)))
        for k in range(parts):
            table = (own.filter(F.pmod(F.xxhash64(term), F.lit(parts)) == k) if parts > 1 else own).toArrow()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            out.append(context.broadcast((sink.getvalue().to_pybytes(), term, how)))
    return out


def term_matches_in(
    texts: DataFrame, terms: DataFrame, *, text_col: str = "text", term_col: str = "source", how: str = "term", keep: list[str] | None = None, positions: str | None = None, shard_chars: int = SHARD_CHARS, most_chars: int = MOST_CHARS
) -> DataFrame:
    """A row for each text and term that meet: columns ``keep`` of the text (all, if not given), all of the term, and ``positions``, where the term begins, if named. The two
    tables share no column name. Terms beyond ``most_chars`` give no positions."""
    spark = texts.sparkSession
    ship(spark)
    columns = list(keep if keep is not None else texts.columns)
    sizes = _sizes(terms, term_col)
    if sum(sizes.values()) > most_chars and not positions:
        return _joined(texts, terms, text_col=text_col, term_col=term_col, how=how, columns=columns)
    left = texts.select(*dict.fromkeys((*columns, text_col)))
    fields = [*(texts.schema[c] for c in columns), *terms.schema.fields, *([T.StructField(positions, T.ArrayType(T.IntegerType()))] if positions else [])]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    found = [left.mapInArrow(_meet(s, text_col, columns, terms.columns, positions), schema) for s in _shards(terms, term_col, how, sizes, shard_chars)]
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_RUN = "[A-Za-z0-9_]+"
#: Of anything but a ``term``: so many characters of its beginning are its key.
_HEAD = 3


def _keys(text: str | None, how: str) -> list[str]:
    """What a term in a text can have as its key."""
    low = fold(text or "")
    if how != "term":
        return list({low[i : i + n] for i in range(len(low)) for n in range(1, _HEAD + 1)})
    return list({m[0] for m in re.finditer(f"{_RUN}|[^A-Za-z0-9_\\s]", low)} | {low[m.start()] for m in re.finditer(f"{_RUN}(?=[一-鿿])", low)} | set(_HAN.findall(low)))


def _key(term: str | None, how: str) -> str | None:
    t = (term or "") if how == "exact" else (term or "").strip()
    if not t:
        return None
    low = fold(t)
    if how != "term":
        return low[:_HEAD]
    run = re.search(_RUN, low)
    return low[0] if _HAN.search(t) or not run else run[0]


def _joined(texts: DataFrame, terms: DataFrame, *, text_col: str, term_col: str, how: str, columns: list[str]) -> DataFrame:
    """The same rows by an equi-join: keys of the texts with a number of the row, keys of the terms, and then the texts of rows that met a key, once each with all their terms."""
    numbered = kept(texts.select(F.monotonically_increasing_id().alias("__row"), F.struct(*(F.col(c) for c in dict.fromkeys((*columns, text_col)))).alias("__left")))
    text_keys = F.udf(lambda x: _keys(x, how), T.ArrayType(T.StringType()), useArrow=True)
    term_key = F.udf(lambda x: _key(x, how), T.StringType(), useArrow=True)
    right = terms.select(F.struct("*").alias("__term"), term_key(term_col).alias("__key")).filter("__key IS NOT NULL")
    met = numbered.select("__row", F.explode(text_keys(F.col(f"__left.{text_col}"))).alias("__key")).join(right, "__key").select("__row", "__term")
    stands = F.udf(lambda t, x: bool(x) and bool(Terms([t], how).matches(x)), T.BooleanType(), useArrow=True)
    both = numbered.join(met, "__row").filter(stands(F.col(f"__term.{term_col}"), F.col(f"__left.{text_col}")))
    return both.select(*(F.col(f"__left.{c}").alias(c) for c in columns), "__term.*")


def _tally(shared, text: str, name: str):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, terms = _built(shared)
        for batch in batches:
            n = pa.array([len(terms.matches(x)) if x else 0 for x in batch.column(text).to_pylist()], pa.int32())
            k = batch.schema.get_field_index(name)
            if k >= 0:
                yield batch.set_column(k, name, pc.add(batch.column(k), n))
            else:
                yield batch.append_column(name, n)

    return tally


def with_term_count(texts: DataFrame, terms: DataFrame, *, name: str, text_col: str = "text", term_col: str = "source", how: str = "term", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``texts`` with the number of terms that each holds, in place: no row moves."""
    ship(texts.sparkSession)
    shards = _shards(terms.select(term_col), term_col, how, _sizes(terms, term_col), shard_chars)
    if not shards:
        return texts.withColumn(name, F.lit(0))
    out = texts
    schema = T.StructType([*texts.schema.fields, T.StructField(name, T.IntegerType())])
    for s in shards:
        out = out.mapInArrow(_tally(s, text_col, name), schema)
    return out
