"""What is handed to a writer or a translator at once: batches along semantic units, and packets of evidence for the sections of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.operators.sequence import pack


def tiling_units(units: DataFrame, segments: DataFrame) -> DataFrame:
    """Of units (doc_id, start_segment, end_segment; of any type, and wrong ones), those of documents that they tile: every segment of segments(doc_id, seg_idx) in one unit, none in two.

    Whether they do is told by sizes and by each unit's distance from the one before, so no unit is spread over its segments for it."""
    number = lambda c: F.expr(f"try_cast({c} AS INT)").alias(c)
    sizes = segments.groupBy("doc_id").agg(F.count("*").alias("size"))
    real = units.select("doc_id", number("start_segment"), number("end_segment")).join(sizes, "doc_id").filter("0 <= start_segment AND start_segment <= end_segment AND end_segment < size")
    before = F.lag("end_segment", 1, -1).over(Window.partitionBy("doc_id").orderBy("start_segment", "end_segment"))
    placed = real.withColumn("joined", F.col("start_segment") == before + 1)
    tiled = placed.groupBy("doc_id", "size").agg(F.bool_and("joined").alias("joined"), F.sum(F.col("end_segment") - F.col("start_segment") + 1).alias("covered")).filter("joined AND covered = size")
    return placed.join(tiled.select("doc_id"), "doc_id", "left_semi").select("doc_id", "start_segment", "end_segment")


def pack_units(segments: DataFrame, units: DataFrame, *, most: int = 4, chars: int = 1600) -> DataFrame:
    """Batches as of ``pack``, none across units where the units tile a document; documents that they don't tile are packed as if they had none."""
    tiles = tiling_units(units, segments).withColumn("seg_idx", F.explode(F.sequence("start_segment", "end_segment")))
    own = segments.select("doc_id", "seg_idx", "text").join(tiles.select("doc_id", "seg_idx", F.col("start_segment").alias("unit")), ["doc_id", "seg_idx"], "left")
    return pack(own, most=most, chars=chars, unit_col="unit")


def _known(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Edges of kinds that a registry (kind, ref, allowed) lists, to rows that it has and allows."""
    return edges.join(registry.filter("allowed").select("kind", "ref").distinct(), ["kind", "ref"], "left_semi").select("doc_id", "section_id", "kind", "ref", "pos")


def section_packets(sections: DataFrame, edges: DataFrame, registry: DataFrame, segments: DataFrame, glossary: DataFrame, injected: DataFrame, *, shown: int = 40, terms: int = 30) -> DataFrame:
    """(doc_id, section_id, kind, n, ref): what each section's packet holds, in order.

    sections(doc_id, section_id, title, purpose); edges(doc_id, section_id, kind, ref, pos) to claims, cases, literature, statistics, with a case's segment in ``seg_idx``; segments(doc_id, seg_idx); glossary(id, pos);
    injected(doc_id, seg_idx, id), the entries that a segment was translated with. Of each kind those that the registry has and allows are given. Segments that a section may look at are its document's: all, or of more than ``shown``
    the first and the last. A section on terms gets the head of the glossary, others the entries of their cases' segments."""
    c = F.col
    named = _known(edges, registry)
    order = Window.partitionBy("doc_id").orderBy("seg_idx")
    placed = segments.select("doc_id", "seg_idx", F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy("doc_id")).alias("size"))
    seen = placed.filter((c("n") < shown) | (c("n") == c("size")))
    available = sections.select("doc_id", "section_id").join(seen, "doc_id").select("doc_id", "section_id", F.lit("segment").alias("kind"), c("seg_idx").cast("string").alias("ref"), c("n").alias("pos"))
    about = F.contains(F.concat_ws("", "title", "purpose"), F.lit("术语"))
    head = [(r["id"], r["pos"]) for r in glossary.orderBy("pos", "id").limit(terms).select("id", F.col("pos").cast("long").alias("pos")).collect()]
    listed = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).cast("long").alias("pos")) for i, p in head])
    whole = sections.filter(about).select("doc_id", "section_id", F.inline(listed)) if head else None
    own = edges.filter("kind = 'case'").join(registry.filter("allowed AND kind = 'case'").select("ref"), "ref", "left_semi").join(sections.filter(~about).select("doc_id", "section_id"), ["doc_id", "section_id"], "left_semi")
    used = own.join(injected, ["doc_id", "seg_idx"]).select("doc_id", "section_id", "id").distinct().join(glossary, "id")
    chosen = used if whole is None else used.select("doc_id", "section_id", "id", "pos").unionByName(whole)
    decisions = chosen.select("doc_id", "section_id", F.lit("term").alias("kind"), c("id").alias("ref"), "pos")
    parts = named.unionByName(available).unionByName(decisions)
    return parts.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "section_id", "kind").orderBy("pos", "ref"))).select("doc_id", "section_id", "kind", "n", "ref")
