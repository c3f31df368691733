"""The chain of literature from its sources to a report's sections: what breaks it, how far each source reaches, and how an outline is closed over it.

sources(source_id, content_hash); blocks(source_id, block_id, location, text); evidence(evidence_id, source_id, source_hash, evidence_type, block_id, location, text, eligible); literature claims(claim_id, source_id, supports);
global claims(claim_id, literature_claims, literature_evidence, support_category); sections(section_id, claims). Ids are unique in their table; null lists are empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Deals rows by keys into parts, before a join or a grouping by these.
Deal = Callable[..., DataFrame]


def as_they_are(df: DataFrame, *keys: str) -> DataFrame:
    return df


def _edges(df: DataFrame, key: str, many: str, name: str) -> DataFrame:
    return df.select(F.col(key), F.explode(many).alias(name))


def _size(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _known(df: DataFrame, c: str, name: str) -> DataFrame:
    return df.select(F.col(c).alias(name)).distinct()


def chain_violations(sources: DataFrame, blocks: DataFrame, evidence: DataFrame, claims: DataFrame, global_claims: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """(type, subject, ref): each broken link, with what it belongs to and what it names."""
    c = F.col

    def rule(df: DataFrame, kind: str, subject: str, ref: str) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), c(subject).alias("subject"), c(ref).alias("ref"))

    evidence, claims_of_sources = deal(evidence, "source_id"), deal(claims, "source_id")
    placed = evidence.join(sources, "source_id")
    whole = placed.filter(~c("evidence_type").eqNullSafe("metadata_only"))
    met = deal(whole, "source_id", "block_id").join(blocks.select("source_id", "block_id", c("location").alias("__location"), c("text").alias("__text"), F.lit(True).alias("__there")), ["source_id", "block_id"], "left")
    there = met.filter("__there")
    cited = deal(_edges(claims, "claim_id", "supports", "evidence_id"), "claim_id").join(claims.select("claim_id", c("source_id").alias("__own")), "claim_id")
    cited = deal(cited, "evidence_id")
    found = cited.join(evidence.select("evidence_id", "source_id", "eligible"), "evidence_id")
    asked = deal(_edges(global_claims, "claim_id", "literature_claims", "literature_claim_id"), "literature_claim_id")
    given = deal(_edges(global_claims, "claim_id", "literature_evidence", "evidence_id"), "evidence_id")
    allowed = asked.join(_edges(claims, "claim_id", "supports", "evidence_id").withColumnRenamed("claim_id", "literature_claim_id"), "literature_claim_id").select("claim_id", "evidence_id")
    allowed = deal(allowed, "claim_id", "evidence_id").distinct()
    paper = _known(sources, "source_id", "evidence_id")
    other = given.join(paper, "evidence_id", "left_anti")
    known = _known(evidence, "evidence_id", "evidence_id")
    needs = global_claims.filter(c("support_category").isin("literature_supported", "mixed_evidence") & ((_size("literature_claims") == 0) | (_size("literature_evidence") == 0)))
    return reduce(
        DataFrame.unionByName,
        (
            rule(evidence.join(sources, "source_id", "left_anti"), "literature_evidence_source_missing", "evidence_id", "source_id"), rule(placed.filter(~c("source_hash").eqNullSafe(c("content_hash"))), "literature_source_hash_mismatch", "evidence_id", "source_id"),
            rule(met.filter("__there IS NULL"), "invalid_literature_location", "evidence_id", "block_id"), rule(there.filter(~c("location").eqNullSafe(c("__location"))), "invalid_literature_location", "evidence_id", "location"),
            rule(there.filter(F.coalesce("__text", F.lit("")) != F.coalesce("text", F.lit(""))), "literature_evidence_text_mismatch", "evidence_id", "block_id"), rule(claims_of_sources.join(sources, "source_id", "left_anti"), "literature_claim_source_missing", "claim_id", "source_id"),
            rule(claims.filter(_size("supports") == 0), "literature_claim_without_evidence", "claim_id", "source_id"), rule(cited.join(known, "evidence_id", "left_anti"), "literature_claim_unknown_evidence", "claim_id", "evidence_id"),
            rule(found.filter(~c("source_id").eqNullSafe(c("__own")) | ~F.coalesce("eligible", F.lit(False))), "literature_claim_evidence_mismatch", "claim_id", "evidence_id"),
            rule(asked.join(_known(claims, "claim_id", "literature_claim_id"), "literature_claim_id", "left_anti"), "global_claim_unknown_literature_claim", "claim_id", "literature_claim_id"),
            rule(given.join(paper, "evidence_id", "left_semi"), "argument_plan_source_id_without_grounding", "claim_id", "evidence_id"), rule(other.join(known, "evidence_id", "left_anti"), "global_claim_unknown_literature_evidence", "claim_id", "evidence_id"),
            rule(other.join(known, "evidence_id", "left_semi").join(allowed, ["claim_id", "evidence_id"], "left_anti"), "global_claim_literature_support_mismatch", "claim_id", "evidence_id"), rule(needs, "global_claim_missing_literature_grounding", "claim_id", "support_category"),
        ),
    )


def lineage(sources: DataFrame, evidence: DataFrame, claims: DataFrame, global_claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Of each source how many pieces of evidence, literature claims, global claims and sections it reaches, hop by hop, each counted once."""
    own = claims.select("source_id", F.col("claim_id").alias("literature_claim_id"))
    reached = own.join(_edges(global_claims, "claim_id", "literature_claims", "literature_claim_id"), "literature_claim_id").select("source_id", "claim_id").distinct()
    placed = reached.join(_edges(sections, "section_id", "claims", "claim_id"), "claim_id").select("source_id", "section_id").distinct()
    counts = [df.groupBy("source_id").agg(F.count("*").alias(name)) for df, name in ((evidence, "n_evidence"), (own, "n_literature_claims"), (reached, "n_global_claims"), (placed, "n_sections"))]
    out = reduce(lambda a, b: a.join(b, "source_id", "left"), counts, sources.select("source_id"))
    return out.fillna(0)


def closed_outline(sections: DataFrame, claims: DataFrame, questions: DataFrame, cases: DataFrame, evidence: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """(doc_id, section_id, kind, ref): an outline in which nothing is lost.

    sections(doc_id, section_id, pos, claims, cases), claims(doc_id, claim_id, cases, literature_claims, literature_evidence), questions(doc_id, rq), cases(doc_id, case_id, synthetic), evidence(evidence_id, source_id). Every section has all
    questions. Claims that no section has go to a document's last one. So do made-up cases that none has; other such cases go to the section that shares most claims with them, the first of equals, and cases
    that no claim names go nowhere. Sections get the literature of their claims, and its sources."""
    c = F.col
    last = sections.groupBy("doc_id").agg(F.max_by("section_id", "pos").alias("section_id"))
    planned = _planned(sections, "claims")
    lost = deal(claims.select("doc_id", c("claim_id").alias("ref")), "doc_id", "ref").join(planned.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti").join(last, "doc_id").select("doc_id", "section_id", "ref")
    own = deal(planned.unionByName(lost), "doc_id", "ref").distinct()
    had = _planned(sections, "cases")
    free = deal(cases, "doc_id", "case_id").join(had.select("doc_id", c("ref").alias("case_id")), ["doc_id", "case_id"], "left_anti")
    named = claims.select("doc_id", c("claim_id").alias("claim"), F.explode("cases").alias("case_id"))
    # a section that shares nothing may still be the first of equals
    shared = deal(free.filter("NOT synthetic").join(named, ["doc_id", "case_id"]), "doc_id", "claim").join(planned.withColumnRenamed("ref", "claim"), ["doc_id", "claim"], "left")
    shared = deal(shared, "doc_id", "case_id").groupBy("doc_id", "case_id", "section_id").agg(F.countDistinct("claim").alias("n"))
    first = sections.groupBy("doc_id").agg(F.min_by("section_id", "pos").alias("__first"))
    ranked = deal(deal(shared, "doc_id", "section_id").join(sections.select("doc_id", "section_id", "pos"), ["doc_id", "section_id"], "left"), "doc_id", "case_id").groupBy("doc_id", "case_id").agg(F.max_by("section_id", F.when(c("section_id").isNotNull(), F.struct("n", (-c("pos")).alias("p")))).alias("section_id"))
    landed = deal(ranked, "doc_id").join(first, "doc_id").select("doc_id", F.coalesce("section_id", "__first").alias("section_id"), c("case_id").alias("ref"))
    made = free.filter("synthetic").join(last, "doc_id").select("doc_id", "section_id", c("case_id").alias("ref"))
    of_claims = own.join(claims.withColumnRenamed("claim_id", "ref"), ["doc_id", "ref"])
    lit = lambda many: deal(of_claims.select("doc_id", "section_id", F.explode(many).alias("ref")), "doc_id", "section_id", "ref").distinct()
    sourced = deal(lit("literature_evidence"), "ref").join(evidence, c("ref") == c("evidence_id")).select("doc_id", "section_id", c("source_id").alias("ref"))
    sourced = deal(sourced, "doc_id", "section_id", "ref").distinct()
    parts = {
        "research_question": deal(sections.select("doc_id", "section_id"), "doc_id").join(questions, "doc_id").select("doc_id", "section_id", c("rq").alias("ref")), "claim": own, "case": had.unionByName(landed).unionByName(made).distinct(), "literature_claim": lit("literature_claims"),
        "literature_evidence": lit("literature_evidence"), "literature_source": sourced,
    }
    return reduce(DataFrame.unionByName, (df.select("doc_id", "section_id", F.lit(kind).alias("kind"), "ref") for kind, df in parts.items()))


def _planned(sections: DataFrame, many: str) -> DataFrame:
    return sections.select("doc_id", "section_id", F.explode(many).alias("ref"))
