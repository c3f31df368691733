"""Evidence graphs: claims, their evidence and sources, as edge tables, with violations as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claim_violations(claims: DataFrame, evidence: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (type, severity, subject) for each broken rule of the chain claim, evidence, block, source.

    claims(claim_id, source_id, evidence_ids), evidence(evidence_id, source_id, block_id, text, content_hash, eligible),
    sources(source_id, citable), blocks(block_id, source_id, text)."""
    row = lambda df, kind, subject, severity="error": df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col(subject).alias("subject"))
    cited = claims.select("claim_id", F.col("source_id").alias("claim_source"), F.explode_outer("evidence_ids").alias("evidence_id"))
    met = cited.filter("evidence_id IS NOT NULL").join(evidence, "evidence_id", "left")
    placed = evidence.join(blocks.select("block_id", F.col("source_id").alias("block_source"), F.col("text").alias("block_text")), "block_id", "left")
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rules = [
        row(cited.filter("evidence_id IS NULL"), "claim_without_evidence", "claim_id"),
        row(met.filter("source_id IS NULL"), "claim_unknown_evidence", "claim_id"),
        row(met.filter("source_id IS NOT NULL AND source_id <> claim_source"), "claim_evidence_mismatch", "claim_id"),
        row(met.filter("eligible = false"), "claim_ineligible_evidence", "claim_id"),
        row(claims.join(sources, "source_id", "left_anti"), "claim_source_missing", "claim_id"),
        row(claims.join(sources.filter("NOT citable"), "source_id", "left_semi"), "uncitable_source", "claim_id"),
        row(evidence.join(sources, "source_id", "left_anti"), "evidence_source_missing", "evidence_id"),
        row(placed.filter("block_source IS NULL OR block_source <> source_id"), "invalid_location", "evidence_id"),
        row(placed.filter(~F.contains(squeezed("block_text"), squeezed("text"))), "evidence_text_mismatch", "evidence_id"),
        row(evidence.filter(F.sha2("text", 256) != F.col("content_hash")), "evidence_hash_mismatch", "evidence_id"),
        row(evidence.join(cited, "evidence_id", "left_anti"), "unused_evidence", "evidence_id", "warning"),
    ]
    return reduce(DataFrame.unionByName, rules)


def status(violations: DataFrame) -> DataFrame:
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0))
    return violations.agg(n("error").alias("errors"), n("warning").alias("warnings")).withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "pass_with_warnings").otherwise("pass"))


def lineage(sources: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Per source: its evidence, and the claims that rest on it."""
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("evidence_id"))
    used = evidence.select("source_id", "evidence_id").join(cited, "evidence_id", "left")
    n = used.groupBy("source_id").agg(F.countDistinct("evidence_id").alias("n_evidence"), F.countDistinct("claim_id").alias("n_claims"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.select("source_id").join(n, "source_id", "left").select("source_id", zero("n_evidence"), zero("n_claims"))


def bundles(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON object per pair with its findings in order, as an exporter writes them line by line."""
    keys = ("arm", "conv_id", "seg_idx")
    own = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("type", "severity", "reason"))).alias("findings"))
    empty = F.array().cast("array<struct<type:string,severity:string,reason:string>>")
    return pairs.join(own, list(keys), "left").select("conv_id", "seg_idx", F.to_json(F.struct("source", "target", F.coalesce("findings", empty).alias("findings"))).alias("line"))


def within_budget(lines: DataFrame, *, chars: int = 9000) -> DataFrame:
    """Of each conversation's lines, in order, those before the running total passes the budget."""
    from pyspark.sql import Window

    total = F.sum(F.length("line")).over(Window.partitionBy("conv_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("total", total).filter(F.col("total") <= chars).select("conv_id", "seg_idx", "total")
