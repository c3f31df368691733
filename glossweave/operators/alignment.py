"""Old translations carried over to a new division of a text that has changed.

Both divisions are streams of characters that white space, case and the shapes of quotes and dashes don't touch. Every old source is looked for in the new stream, from the
end of the one placed before it on, and if it isn't there, from the beginning. A new paragraph is reused if the old sources that lie
wholly within it make up all of it.

What is looked for and what comes of it are joins and groups; only the moving cursor runs in Python, over one document's two streams at a time: as much text as a row of the documents holds.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.functions.text import CJK, incomplete, strip
from glossweave.shipping import ship


def stream_form(text: Column) -> Column:
    """A text as streams are compared."""
    plain = F.replace(F.translate(text, "’‘“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))
    return F.lower(F.regexp_replace(plain, r"(?U)\s+", ""))


_PLACE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("first_new", "last_new")]))


def _found(forms: list[str | None], numbers: list[int], new: list[str]) -> list[tuple[int, int] | None]:
    """Of a document's old sources, null where none is looked for, the new paragraphs that hold the beginning and the end."""
    starts = list(accumulate(map(len, new), initial=0))[:-1]
    stream = "".join(new)
    out: list[tuple[int, int] | None] = []
    cursor = 0
    for form in forms:
        p = -1
        if form is not None:
            p = stream.find(form, cursor)
            if p < 0:
                p = stream.find(form, 0, cursor + len(form))
        if p >= 0:
            cursor = p + len(form)
        out.append(None if p < 0 else tuple(numbers[bisect_right(starts, x) - 1] for x in (p, cursor - 1)))
    return out


@F.arrow_udf(_PLACE)
def _placed(forms: pa.Array, numbers: pa.Array, new: pa.Array) -> pa.Array:
    rows = [_found(f.as_py() or [], n.as_py() or [], x.as_py() or []) for f, n, x in zip(forms, numbers, new, strict=True)]
    at = [[p and {"first_new": p[0], "last_new": p[1]} for p in row] for row in rows]
    return pa.array(at, pa.list_(pa.struct([("first_new", pa.int32()), ("last_new", pa.int32())])))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("not_found", "reused")]))
def _taken(forms: pa.Array, numbers: pa.Array, new: pa.Array) -> pa.Array:
    """Per document: old sources not found, and new paragraphs that those within them make up."""
    out = []
    for f, n, x in zip(forms, numbers, new, strict=True):
        f, n, x = f.as_py() or [], n.as_py() or [], x.as_py() or []
        at = _found(f, n, x)
        within: dict[int, list[str]] = {}
        for form, p in zip(f, at, strict=True):
            if p and p[0] == p[1]:
                within.setdefault(p[0], []).append(form)
        out.append({"not_found": at.count(None), "reused": sum(k in within and "".join(within[k]) == form for k, form in zip(n, x, strict=True))})
    return pa.array(out, pa.struct([("not_found", pa.int64()), ("reused", pa.int64())]))


def _known(old: DataFrame) -> DataFrame:
    """With ``form`` and ``fit``: null of what is looked for."""
    known = old.withColumn("form", stream_form(F.coalesce("source", F.lit(""))))
    suspect = (strip(F.coalesce("target", F.lit(""))) == "") | incomplete(F.coalesce("source", F.lit("")), F.col("target"))
    return known.withColumn("fit", F.when(F.col("form") == "", "empty").when(suspect, "suspect"))


def _sorted(*columns) -> Column:
    return F.array_sort(F.collect_list(F.struct(*columns)))


def _streams(new: DataFrame) -> DataFrame:
    """new(doc_id, new_idx, text) as a document's sorted numbers and forms."""
    return new.select("doc_id", F.col("new_idx").cast("int").alias("new_idx"), stream_form(F.coalesce("text", F.lit(""))).alias("form")).groupBy("doc_id").agg(_sorted("new_idx", "form").alias("new"))


def placements(old: DataFrame, new: DataFrame) -> DataFrame:
    """old(doc_id, seg_idx, source, target) with ``state`` (suspect: the target is blank or cut short, so it isn't looked for; placed; not_found; or empty: nothing to look for) and
    the new paragraphs that hold its beginning and end. new(doc_id, new_idx, text)."""
    ship(old.sparkSession)
    asked = _known(old).groupBy("doc_id").agg(_sorted("seg_idx", "form", "source", "target", "fit").alias("old"))
    forms = F.transform("old", lambda x: F.when(x["fit"].isNull(), x["form"]))
    both = asked.join(_streams(new), "doc_id", "left").withColumn("at", _placed(forms, F.col("new.new_idx"), F.col("new.form")))
    each = both.select("doc_id", F.explode(F.arrays_zip("old", "at")).alias("z")).select("doc_id", "z.old.*", "z.at.*")
    state = F.coalesce("fit", F.when(F.col("first_new").isNull(), "not_found").otherwise("placed"))
    return each.select("doc_id", "seg_idx", "source", "target", "form", state.alias("state"), "first_new", "last_new")


def reused(placed: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, new_idx, n_old, target) of the new paragraphs that ``placements`` fill: Han targets are joined as they are, others by spaces."""
    whole = placed.filter("first_new = last_new").groupBy("doc_id", F.col("first_new").alias("new_idx")).agg(F.array_sort(F.collect_list(F.struct("seg_idx", "form", "target"))).alias("old"))
    form = F.array_join(F.transform("old", lambda x: x["form"]), "")
    parts = F.transform("old", lambda x: strip(x["target"]))
    han = F.col("old")[0]["target"].rlike(CJK)
    target = F.when(han, F.array_join(parts, "")).otherwise(F.array_join(parts, " "))
    met = new.join(whole, ["doc_id", "new_idx"]).filter(form == stream_form(F.coalesce("text", F.lit(""))))
    return met.select("doc_id", "new_idx", F.size("old").alias("n_old"), target.alias("target"))


def alignment_statistics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document: old segments, suspect ones, ones not found, new paragraphs and those reused. As ``placements`` and ``reused`` have them, but counted where a document is placed: its two streams are all that
    is grouped, and if ``old`` and ``new`` are dealt by doc_id, nothing is shuffled here."""
    ship(old.sparkSession)
    asked = F.when(F.col("fit").isNull(), F.struct("seg_idx", "form"))
    was = _known(old).groupBy("doc_id").agg(F.count("*").alias("old_total"), F.count_if(F.col("fit") == "suspect").alias("skipped_suspect"), F.array_sort(F.collect_list(asked)).alias("old"))
    both = was.join(_streams(new), "doc_id", "full_outer").filter("doc_id IS NOT NULL OR old_total IS NOT NULL")  # no filter before the join, so that both sides can read the same shuffle
    both = both.withColumn("n", _taken(F.col("old.form"), F.col("new.new_idx"), F.col("new.form")))
    each = both.select("doc_id", "old_total", "skipped_suspect", "n.not_found", F.coalesce(F.array_size("new"), F.lit(0)).cast("long").alias("new_total"), "n.reused")
    return each.fillna(0, ["old_total", "skipped_suspect"])
