"""Literature: registry rows made sound, ids told apart, sources cut into evidence, and claims grounded in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import strip
from glossweave.shipping import ship

# What a source's verification may be, older names for it, and which of these may be cited.
STATUSES = ("candidate", "metadata_verified", "user_provided", "imported_unverified", "rejected")
LEGACY = {"verified": "metadata_verified", "imported_notes": "imported_unverified", "unverified_candidate": "candidate"}
CITABLE = ("metadata_verified", "user_provided")
CONTENT = ("full_text_available", "partial_text_available", "notes_only", "metadata_only")
PROVENANCE = {"content": ("source_text_verified", "source_passage"), "note": ("user_note", "note"), "excerpt": ("manual_excerpt", "excerpt"), "passage": ("model_extracted_from_source", "source_passage")}


def slug(x: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9_-]+", "-"), "^[-_]+|[-_]+$", ""))
    return F.when(s == "", "reference").otherwise(s)


_NUMBERED = re.compile(r"(.+)-([1-9][0-9]*)")


class _Given:
    """The ids that a family of names has been given; as large as its different names, however many rows they have."""

    def __init__(self) -> None:
        self.plain: set[str] = set()
        self.next: dict[str, int] = {}

    def used(self, name: str) -> bool:
        if name in self.plain:
            return True
        found = _NUMBERED.fullmatch(name)
        return bool(found) and 2 <= int(found[2]) < self.next.get(found[1], 2)

    def give(self, name: str) -> str:
        if not self.used(name):
            self.plain.add(name)
            return name
        k = self.next.get(name, 2)
        while f"{name}-{k}" in self.plain:
            k += 1
        self.next[name] = k + 1
        return f"{name}-{k}"


def _give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family, given = None, _Given()
    for batch in batches:
        out = []
        for own, name in zip(batch.column("__family").to_pylist(), batch.column("__slug").to_pylist(), strict=True):
            if own != family:
                family, given = own, _Given()
            out.append(given.give(name))
        yield batch.set_column(batch.schema.get_field_index("unique_id"), "unique_id", pa.array(out, pa.string()))


def unique_ids(rows: DataFrame, name: str, pos: str) -> DataFrame:
    """``rows`` with ``unique_id``, in the order of ``pos``: the slug of ``name``, or if a row before has that id, the slug with the least of -2, -3 and so on that none has.

    Names are a family if they differ in numbers at their ends only. Where no name of a family ends in a number, a row's number is its place among equal names. Other
    families pass in order through a task row by row, which keeps their different names, not their rows."""
    ship(rows.sparkSession)
    own = rows.withColumn("__slug", slug(F.col(name))).withColumn("__family", F.regexp_replace("__slug", "(?:-[0-9]+)+$", ""))
    mixed = own.filter("__slug <> __family").select("__family").distinct()
    alike = own.join(mixed, "__family", "left_anti")
    n = F.row_number().over(Window.partitionBy("__slug").orderBy(pos))
    alike = alike.withColumn("__n", n).withColumn("unique_id", F.when(F.col("__n") == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", "__n"))).drop("__n")
    # by an expression of its own: a repartition by the join's key is dropped, and a join that turns out small is then read in other parts
    other = own.join(mixed, "__family", "left_semi").withColumn("unique_id", F.lit(None).cast("string")).repartition(F.xxhash64("__family")).sortWithinPartitions("__family", pos)
    return alike.unionByName(other.mapInArrow(_give, other.schema)).drop("__slug", "__family")


def registry(rows: DataFrame) -> DataFrame:
    """Registry rows (source_id, title, authors, year, status, content_availability, allowed, has_content, n_excerpts, n_notes, pos): the first of each
    id, authors as a list, known values only, and cited only if the status allows it and title, author and year are there."""
    c = F.col
    once = rows.filter(F.trim(F.coalesce("source_id", F.lit(""))) != "").withColumn("source_id", F.trim("source_id")).withColumn("__n", F.row_number().over(Window.partitionBy(F.trim("source_id")).orderBy("pos"))).filter("__n = 1").drop("__n")
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv])[F.trim("status")], F.trim("status"), F.lit("candidate"))
    status = F.when(named.isin(*STATUSES), named).otherwise("candidate")
    authors = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), "[;；]"), lambda x: F.trim(x)), lambda x: x != "")
    content = F.when(c("content_availability").isin(*CONTENT), c("content_availability")).when(c("has_content"), CONTENT[0]).when(c("n_excerpts") > 0, CONTENT[1]).when(c("n_notes") > 0, CONTENT[2]).otherwise(CONTENT[3])
    own = once.withColumn("status", status).withColumn("authors", authors).withColumn("content_availability", content)
    whole = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.size("authors") > 0) & c("year").isNotNull()
    return own.withColumn("citation_allowed", F.coalesce("allowed", c("status").isin(*CITABLE)) & c("status").isin(*CITABLE) & whole)


def blocks(sources: DataFrame, *, most: int = 80, chars: int = 1200) -> DataFrame:
    """Sources (source_id, kind, text, pos) cut into blocks: paragraphs in pieces of ``chars``, the first of equal blocks, ``most`` of a source.

    kind is content, note, excerpt or passage; content comes first, then notes, excerpts and passages."""
    rank = F.array_position(F.array(*map(F.lit, PROVENANCE)), F.col("kind"))
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    each = sources.select("source_id", "kind", rank.alias("rank"), "pos", F.posexplode(paragraphs).alias("paragraph", "whole"))
    pieces = F.transform(F.sequence(F.lit(0), F.length("whole") - 1, F.lit(chars)), lambda i: F.substring(F.col("whole"), i + 1, F.lit(chars)))
    cut = each.select("source_id", "kind", "rank", "pos", "paragraph", F.posexplode(pieces).alias("piece", "text"))
    cut = cut.withColumn("block_id", F.substring(F.sha2(F.concat_ws("|", "source_id", "kind", "text"), 256), 1, 16))
    place = ["rank", "pos", "paragraph", "piece"]
    once = cut.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "block_id").orderBy(*place))).filter("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy(*place))).filter(F.col("n") <= most).select("source_id", "kind", "block_id", "n", "text")


def evidence(sources: DataFrame, cut: DataFrame) -> DataFrame:
    """One row of evidence a block, and one that holds only metadata for a source without blocks."""
    named = lambda k: F.create_map(*[F.lit(x) for kind, v in PROVENANCE.items() for x in (kind, v[k])])[F.col("kind")]
    rows = sources.select("source_id").distinct().join(cut, "source_id", "left")
    return rows.select(
        F.concat(F.lit("LE-"), F.substring(F.sha2(F.concat_ws("|", "source_id", F.coalesce("block_id", F.lit("metadata_only"))), 256), 1, 16)).alias("evidence_id"), "source_id", "block_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(named(0), F.lit("metadata_only")).alias("provenance"), F.coalesce(named(1), F.lit("metadata_only")).alias("evidence_type"), (F.coalesce("text", F.lit("")) != "").alias("eligible"),
    )


def availability(found: DataFrame) -> DataFrame:
    """Per source, how much of its text its evidence holds."""
    has = lambda *p: F.bool_or(F.col("provenance").isin(*p))
    level = F.when(has("source_text_verified"), CONTENT[0]).when(has("manual_excerpt", "model_extracted_from_source"), CONTENT[1]).when(has("user_note"), CONTENT[2]).otherwise(CONTENT[3])
    return found.groupBy("source_id").agg(F.count_if("eligible").alias("n_evidence"), level.alias("availability"))


def ground(claims: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (claim_id, source_id, statement, evidence_ids) with the evidence that holds: of their own source, eligible, once; and how they are
    grounded by it. Claims without a statement, a known source or such evidence are rejected."""
    cited = claims.select("claim_id", F.col("source_id").alias("of"), F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    kept = cited.join(found.filter("eligible").select("evidence_id", "source_id", "provenance"), "evidence_id").filter("of = source_id").groupBy("claim_id", "evidence_id", "provenance").agg(F.min("pos").alias("pos"))
    per = kept.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("supported_by"), F.bool_and(F.col("provenance") == "source_text_verified").alias("text"), F.bool_or(F.col("provenance") == "model_extracted_from_source").alias("model"))
    own = claims.join(per, "claim_id", "left").join(sources.select("source_id", F.lit(True).alias("known")).distinct(), "source_id", "left")
    fine = (strip(F.coalesce("statement", F.lit(""))) != "") & F.coalesce("known", F.lit(False)) & F.col("supported_by").isNotNull()
    status = F.when(~fine, "rejected").when(F.col("text"), "grounded").when(F.col("model"), "needs_review").otherwise("grounded_user_material")
    return own.select("claim_id", "source_id", F.when(fine, F.col("supported_by")).alias("supported_by"), status.alias("status"))


def plan_grounding(claims: DataFrame, literature_claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Claims of an argument plan (claim_id, project, literature_claims, literature_evidence), kept to what is known: segments, literature claims
    (literature_claim_id, evidence_ids), and of the evidence what those claims rest on; with what they are thus supported by."""
    a = claims.select("claim_id", F.explode("project").alias("ref")).join(segments.select(F.col("segment_id").alias("ref")).distinct(), "ref", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("ref")).alias("project"))
    b = claims.select("claim_id", F.explode("literature_claims").alias("literature_claim_id")).join(literature_claims, "literature_claim_id")
    held = b.groupBy("claim_id").agg(F.array_sort(F.collect_set("literature_claim_id")).alias("literature_claims"), F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("rests_on"))
    own = claims.select("claim_id", "literature_evidence").join(a, "claim_id", "left").join(held, "claim_id", "left")
    empty = F.array().cast("array<string>")
    own = own.withColumn("project", F.coalesce("project", empty)).withColumn("literature_claims", F.coalesce("literature_claims", empty)).withColumn("literature_evidence", F.array_sort(F.array_intersect("literature_evidence", F.coalesce("rests_on", empty)))).drop("rests_on")
    p, lit = F.size("project") > 0, (F.size("literature_claims") > 0) & (F.size("literature_evidence") > 0)
    return own.withColumn("support", F.when(p & lit, "mixed").when(lit, "literature").when(p, "project").otherwise("author"))
