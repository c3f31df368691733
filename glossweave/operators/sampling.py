"""Review samples: quotas by category, distinct over all, sides dealt evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from glossweave.operators.numbering import kept


def blind_packet(rows: DataFrame, *keys: str, terms: int = 15, repairs: int = 15, long: int = 10, most: int = 80, seed: int = 7) -> DataFrame:
    """A packet of at most ``most`` rows for blind review of two arms, with its key.

    rows(keys, source, target_a, target_b, n_terms, flagged). Rows on which the arms differ come first: those with most terms, flagged ones in order, long ones, and then by a hash of their keys. Each
    category takes its quota from the head of its own order, and rows that were taken before use it up; then what is left of rows that differ fills the packet, and then identical
    ones, in order. ``left`` is the arm that stands on the left: half of them, rounded down, are A, dealt by a hash.

    Every stage is a top-k over the whole table; only the keys taken, ``most`` at most, come to the driver."""
    c = F.col
    hashed = lambda *x: F.md5(F.concat_ws(":", F.lit(seed), *x, *keys))
    own = kept(rows.select(*keys, "n_terms", "flagged", (~c("target_a").eqNullSafe(c("target_b"))).alias("differ"), (F.length("source") + 8 * F.regexp_count("source", F.lit(r"\. "))).alias("dense"), hashed().alias("hash")))
    taken: list[tuple] = []
    categories: list[str] = []

    def take(name: str, pool: DataFrame, order: list[Column | str], quota: int, *, fresh: bool = False) -> None:
        """``fresh``: only rows that weren't taken are counted."""
        if fresh and taken:
            pool = pool.join(F.broadcast(own.sparkSession.createDataFrame(taken, key_schema)), list(keys), "left_anti")
        for r in pool.orderBy(*order, *keys).limit(max(0, quota)).select(*keys).collect():
            if len(taken) < most and tuple(r) not in taken:
                taken.append(tuple(r))
                categories.append(name)

    key_schema = own.select(*keys).schema
    differ = own.filter("differ")
    take("term_dense", differ.filter("n_terms > 0"), [F.desc("n_terms")], terms)
    take("repair_review", differ.filter("flagged"), [], repairs)
    take("long_dense", differ, [F.desc("dense")], long)
    take("random", differ, ["hash"], most - len(taken))
    take("random_fill", differ, [], most - len(taken), fresh=True)
    take("identical_fallback", own.filter("NOT differ"), [], most - len(taken), fresh=True)
    schema = StructType([*key_schema.fields, StructField("packet_id", IntegerType()), StructField("category", StringType())])
    packet = own.sparkSession.createDataFrame([(*k, n, name) for n, (k, name) in enumerate(zip(taken, categories, strict=True), 1)], schema)
    sides = packet.withColumn("deal", F.row_number().over(Window.partitionBy(F.lit("packet")).orderBy(hashed(F.lit("side")), *keys)))  # of ``most`` rows
    sides = sides.withColumn("left", F.when(c("deal") <= len(taken) // 2, "A").otherwise("B")).drop("deal")
    met = rows.select(*keys, "source", "target_a", "target_b").join(F.broadcast(sides), list(keys))
    a = F.when(c("left") == "A", c("target_a")).otherwise(c("target_b"))
    b = F.when(c("left") == "A", c("target_b")).otherwise(c("target_a"))
    return met.select("packet_id", "category", *keys, "source", a.alias("candidate_a"), b.alias("candidate_b"), "left", c("target_a").eqNullSafe(c("target_b")).alias("identical"))


def packet_counts(packet: DataFrame) -> DataFrame:
    """Of each category of a packet, and of all: rows, rows with arm A on the left, and identical ones."""
    return packet.rollup("category").agg(F.count("*").alias("n"), F.count_if(F.col("left") == "A").alias("left_a"), F.count_if("identical").alias("n_identical")).withColumn("category", F.coalesce("category", F.lit("all")))


def context_dependent(segments: DataFrame) -> DataFrame:
    """Segments that open with a connective or pronoun, or follow one that didn't end a sentence."""
    # Openings that lean on what came before.
    openings = "But |And |He |She |It |They |This |That |These |Those |His |Her |Its |Their |Then |So |However|Meanwhile"
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("seg_idx"))
    leans = F.col("text").rlike(f"^(?:{openings}|[\"“'‘])") | ~before.rlike("[.!?…”]$")
    return segments.select("doc_id", "seg_idx", F.coalesce(leans & before.isNotNull(), F.lit(False)).alias("dependent")).filter("dependent").groupBy("doc_id").agg(F.count("*").alias("n_dependent"))
