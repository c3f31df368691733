"""Rules over reports: every rule gives rows (type, severity, doc_id, seg_idx, ref), a report's sections against its plan and the registries.

Sections are (doc_id, seg_idx, body); what a body refers to is taken out by patterns once, as edges, and rules are joins of edges.
Registries are small tables; joins with them are left to Spark, which broadcasts what it measured to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.operators.cases import beside
from glossweave.operators.numbering import kept

KEY = ["doc_id", "seg_idx"]
# How a body marks what it refers to.
MARKERS = {
    "claim": r"<!--claim:([A-Za-z0-9_.:-]+)-->", "rq": r"<!--rq:([A-Za-z0-9_.:-]+)-->", "lit_claim": r"<!--lit-claim:([A-Za-z0-9_.:-]+)-->", "lit_evidence": r"<!--lit-evidence:([A-Za-z0-9_.:-]+)-->",
    "term": r"<!--term:([A-Za-z0-9_.:-]+)-->", "human": r"<!--human-ev:([A-Za-z0-9_.:-]+)-->", "source": r"\[@([A-Za-z0-9_.:-]+)\]", "case": r"(seg-[A-Za-z0-9_-]+-\d{4,})", "synthetic": r"(SC-\d{4,})",
}
AUTHOR_YEAR = r"[A-Z][A-Za-z'’-]+(?:\s+(?:&|and)\s+[A-Z][A-Za-z'’-]+)?\s*\((?:19|20)\d{2}[a-z]?\)|\([A-Z][A-Za-z'’-]+(?:\s+et\s+al\.)?,\s*(?:19|20)\d{2}[a-z]?\)"
THREE_CASES = r"(?i)(?<!第)(?:三个|3\s*个|三则|three)\s*(?:真实|核心|修订|translation\s+revision\s+)*案例"
_HIDDEN = r"(?s)<!--.*?-->"
_NAMES = {"claim": "claim", "case": "case", "rq": "research_question", "lit_claim": "literature_claim", "lit_evidence": "literature_evidence"}


def references(sections: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, kind, ref), each once."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("body", F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref"))) for kind, p in MARKERS.items()]))
    return sections.select(*KEY, F.explode(F.array_distinct(found)).alias("at")).select(*KEY, "at.*")


def _rule(df: DataFrame, kind: str | Column, severity: str | Column = "error", ref: str = "ref") -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(col(kind).alias("type"), col(severity).alias("severity"), *[F.col(c) if c in df.columns else F.lit(None).cast("int").alias(c) for c in KEY], (F.col(ref) if ref in df.columns else F.lit(None).cast("string")).alias("ref"))


def _all(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def outline_violations(sections: DataFrame, plan: DataFrame, known: DataFrame, evidence_sources: DataFrame) -> DataFrame:
    """What is planned but not registered, planned but not in the body, and in the body but not planned. Bodies are read once: what they refer to is kept as edges."""
    used, edges = kept(references(sections)), kept(plan.distinct())
    own = edges.filter(F.col("kind") != "source")
    name = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[F.col("kind")]
    registered = own.join(known, ["kind", "ref"], "left_semi")
    missing = registered.join(used, [*KEY, "kind", "ref"], "left_anti")
    cases_used = own.filter("kind = 'case'").join(used, [*KEY, "kind", "ref"], "left_semi").select(*KEY).distinct().withColumn("some", F.lit(True))
    what = F.when(F.col("kind") == "case", "missing_selected_case").when(F.col("kind") == "rq", "missing_research_question_link").otherwise(F.concat(F.lit("missing_planned_"), name))
    severity = F.when(F.col("kind") == "rq", "warning").when((F.col("kind") == "case") & F.coalesce("some", F.lit(False)), "warning").otherwise("error")
    literature = used.filter("kind IN ('lit_claim', 'lit_evidence')").join(edges, [*KEY, "kind", "ref"], "left_anti")
    of_evidence = edges.filter("kind = 'lit_evidence'").join(evidence_sources, F.col("ref") == F.col("evidence_id")).select(*KEY, F.col("source_id").alias("ref"))
    allowed = edges.filter("kind = 'source'").select(*KEY, "ref").unionByName(of_evidence).distinct()
    both = edges.groupBy(*KEY).agg(F.bool_or(F.col("kind") == "lit_claim").alias("a"), F.bool_or(F.col("kind") == "lit_evidence").alias("b"), F.bool_or(F.col("kind") == "source").alias("s"))
    return _all(
        _rule(own.join(known, ["kind", "ref"], "left_anti"), F.concat(F.lit("outline_unknown_"), name)), _rule(missing.join(cases_used, KEY, "left"), what, severity), _rule(both.filter("s AND NOT (a AND b)"), "outline_source_id_without_grounding"),
        _rule(literature, F.concat(F.lit("section_"), name, F.lit("_outside_plan"))), _rule(used.filter("kind = 'source'").join(allowed, [*KEY, "ref"], "left_anti"), "section_literature_outside_plan"),
    )


def marker_violations(sections: DataFrame, known: DataFrame, sources: DataFrame) -> DataFrame:
    """Markers, citations and terms of a report that no registry has, and citations that say otherwise than the registry."""
    once = kept(references(sections).select("doc_id", "kind", "ref").distinct())
    unknown = {"lit_claim": "unknown_literature_claim_marker", "lit_evidence": "unknown_literature_evidence_marker", "term": "unknown_terminology_decision"}
    lost = once.filter(F.col("kind").isin(*unknown)).join(known, ["kind", "ref"], "left_anti")
    lost_name = F.create_map(*[F.lit(x) for kv in unknown.items() for x in kv])[F.col("kind")]
    cited = once.filter("kind = 'source'").join(sources, F.col("ref") == F.col("source_id"), "left")
    visible = F.regexp_replace("body", r"\[@[^\]]+\]|" + _HIDDEN, "")
    lines = sections.select(*KEY, F.explode(F.split("body", "\n")).alias("body")).withColumn("visible", visible)
    at = lines.select(*KEY, "visible", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(MARKERS["source"]), F.lit(1)))).alias("ref")).join(sources.filter("citable"), F.col("ref") == F.col("source_id"))
    years = F.regexp_extract_all("visible", F.lit(r"(?:19|20)\d{2}"), F.lit(0))
    names = F.split(F.lower("author"), r"\s+")
    named = F.contains(F.lower("visible"), names[0]) | F.contains(F.lower("visible"), F.element_at(names, -1))
    formal = lines.filter(~F.contains("body", F.lit("[@"))).select(*KEY, F.explode(F.regexp_extract_all("body", F.lit(AUTHOR_YEAR), F.lit(0))).alias("ref"))
    bad_source = F.when(F.col("source_id").isNull(), "unknown_literature_citation").when(~F.col("citable"), "uncitable_literature_source")
    other_year = (F.size(years) > 0) & ~F.array_contains(years, F.col("year").cast("string"))
    other_name = F.col("visible").rlike(AUTHOR_YEAR) & ~named
    differs = at.select(*KEY, "ref", F.explode(F.array_compact(F.array(F.when(other_year, "year"), F.when(other_name, "name")))).alias("how"))
    return _all(
        _rule(lost, lost_name), _rule(cited.withColumn("type", bad_source).filter("type IS NOT NULL"), F.col("type")), _rule(differs, "citation_metadata_mismatch"),
        _rule(formal, "unregistered_formal_citation"), _rule(sections.filter(F.contains("body", F.lit("{{TERM:"))).select("doc_id").distinct(), "unresolved_term_token"),
    )


def human_violations(sections: DataFrame, human: DataFrame, claims: DataFrame) -> DataFrame:
    """Human evidence that a report or a claim (claim_id, human_id) refers to and that isn't there, isn't confirmed or is contradicted."""
    used = references(sections).filter("kind = 'human'").select("doc_id", "ref").distinct().join(human, F.col("ref") == F.col("human_id"), "left")
    argued = claims.withColumnRenamed("human_id", "h").join(human, F.col("h") == F.col("human_id"), "left").select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(":", "claim_id", "h").alias("ref"), "human_id", "status")
    confirmed = F.col("status") == "user_confirmed"
    return _all(
        _rule(used.filter("human_id IS NULL"), "unknown_human_evidence"), _rule(used.filter(~confirmed), "unusable_human_evidence"), _rule(used.filter(confirmed & (F.col("conflict") == "contradicted")), "conflicted_human_evidence"),
        _rule(argued.filter("human_id IS NULL"), "argument_unknown_human_evidence"), _rule(argued.filter(~confirmed), "argument_unusable_human_evidence"),
    )


def visible(text: Column) -> Column:
    """Without quoted lines and hidden markers."""
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith(">")), "\n"), _HIDDEN, "")


def english_words(text: Column) -> Column:
    """Words of ASCII letters, with one apostrophe or hyphen at most, that no other letter, digit or underscore touches."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:['’-][\p{L}\p{N}_]+)?"), F.lit(0)), lambda w: w.rlike("^[A-Za-z]+(?:['’-][A-Za-z]+)?$")))


def han_characters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{3400}-\x{9fff}]"))


def language_violations(sections: DataFrame, *, least: int = 12) -> DataFrame:
    """Reports that should be Chinese with a line of sustained English: ``least`` words and more words than Han characters."""
    lines = sections.select("doc_id", F.explode(F.split(visible(F.col("body")), "\n")).alias("line")).filter(~F.ltrim("line").startswith("#"))
    return _rule(lines.filter((english_words(F.col("line")) >= least) & (english_words(F.col("line")) > han_characters(F.col("line")))).select("doc_id").distinct(), "thesis_body_language_mismatch")


def structure_violations(reports: DataFrame, sections: DataFrame, outline: DataFrame, chapters: DataFrame, subsections: DataFrame) -> DataFrame:
    """reports(doc_id, text), sections(doc_id, seg_idx, body), outline(doc_id, seg_idx, title, minimum_chars), chapters(seg_idx, title)
    and subsections(seg_idx, heading, title, level) that an institution asks for."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    there = outline.join(sections, KEY, "left")
    short = there.filter(F.length(F.regexp_replace(F.regexp_replace("body", _HIDDEN, ""), r"\s+", "")) < F.col("minimum_chars"))
    ids = lambda df: F.array_sort(F.collect_set("seg_idx"))
    asked = chapters.agg(ids(chapters).alias("asked"))
    order = beside(outline.groupBy("doc_id").agg(ids(outline).alias("planned")), asked)
    titled = outline.join(chapters.withColumnRenamed("title", "asked_title"), "seg_idx").filter(squeezed("title") != squeezed("asked_title"))
    heading = F.concat(F.lit(r"(?m)^"), F.repeat(F.lit("#"), F.col("level") + 1), F.lit(r"\s+\Q"), F.col("heading"), F.lit(r"\E(?:\s+|[.．、])\Q"), F.col("title"), F.lit(r"\E\s*$"))
    lost = sections.filter(F.trim("body") != "").join(subsections, "seg_idx").filter(~F.regexp_like("body", heading)).withColumn("ref", F.col("heading"))
    return _all(
        _rule(reports.filter(F.trim(F.coalesce("text", F.lit(""))) == ""), "empty_report"), _rule(there.filter("body IS NULL"), "missing_required_section"), _rule(short, "section_too_short", "warning"),
        _rule(order.filter("planned <> asked"), "institutional_chapter_structure_mismatch"), _rule(titled, "institutional_chapter_title_mismatch"), _rule(lost, "missing_institutional_subsection"),
    )


def conclusion_violations(sections: DataFrame) -> DataFrame:
    """Cases that a report's last section is the first to name, as against the section before it."""
    used = references(sections).filter("kind IN ('case', 'synthetic')")
    last = sections.groupBy("doc_id").agg(F.max("seg_idx").alias("last"))
    at = used.join(last, "doc_id")
    return _rule(at.filter("seg_idx = last").join(at.filter("seg_idx = last - 1").select("doc_id", "ref"), ["doc_id", "ref"], "left_anti").select("doc_id", "seg_idx", "ref"), "conclusion_introduces_case_evidence")


def case_policy_violations(cases: DataFrame, recorded: DataFrame, reports: DataFrame, *, preferred: int = 3, minimum: int = 2) -> DataFrame:
    """cases(doc_id, case_id, known, eligible), recorded(doc_id, status) and reports(doc_id, body): does the number of cases fit what is recorded and said, and are they known and real revisions? A report
    to which the policy doesn't apply says so, and its number of cases is then free."""
    n = cases.groupBy("doc_id").agg(F.count("*").alias("n"))
    expected = F.when(F.col("n") >= preferred, "sufficient_revision_cases").when(F.col("n") >= minimum, "two_case_fallback").otherwise("insufficient_revision_cases")
    state = recorded.filter("status <> 'not_applicable'").join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("expected", expected).join(reports, "doc_id")
    two = state.filter("expected = 'two_case_fallback'")
    return _all(
        _rule(state.filter("expected <> status").withColumn("ref", F.col("expected")), "case_count_status_mismatch"), _rule(state.filter("expected = 'insufficient_revision_cases'"), "insufficient_core_revision_cases"),
        _rule(two.filter(~F.contains("body", F.lit("<!--case-count-policy:two_case_fallback-->"))), "missing_revision_evidence_scarcity_disclosure"), _rule(two.filter(F.col("body").rlike(THREE_CASES)), "wrong_core_case_count_claim"),
        _rule(cases.filter("NOT known").withColumn("ref", F.col("case_id")), "invalid_selected_case"), _rule(cases.filter("known AND NOT eligible").withColumn("ref", F.col("case_id")), "non_revision_case_used_as_revision_analysis"),
    )


def synthetic_violations(sections: DataFrame, selected: DataFrame, canonical: DataFrame) -> DataFrame:
    """selected(doc_id, case_id, historical), canonical(case_id, eligible) and what bodies say of synthetic cases."""
    used = references(sections).filter("kind = 'synthetic'").select("doc_id", "ref").distinct()
    chosen = selected.join(canonical.withColumnRenamed("case_id", "c"), F.col("case_id") == F.col("c"), "left").withColumn("ref", F.col("case_id"))
    fit = F.coalesce("eligible", F.lit(False))
    whole = sections.join(selected.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.bool_or(F.contains("body", F.lit("<!--synthetic-methodology-->"))).alias("method"), F.bool_or(F.contains("body", F.lit("<!--synthetic-limitation-->"))).alias("limits"), F.bool_or(F.col("body").rlike("(?i)(?:common|frequent|widespread) human translation error")).alias("frequency"))
    return _all(
        _rule(used.join(selected.withColumnRenamed("case_id", "ref"), ["doc_id", "ref"], "left_anti").join(canonical.withColumnRenamed("case_id", "ref"), "ref", "left_anti"), "unknown_synthetic_case"),
        _rule(chosen.filter(~fit), "ineligible_synthetic_case_selected"), _rule(chosen.filter(fit & F.col("historical")), "synthetic_case_provenance_mismatch"), _rule(whole.filter("NOT method"), "missing_synthetic_methodology_disclosure"),
        _rule(whole.filter("NOT limits"), "missing_synthetic_limitation_disclosure"), _rule(whole.filter("frequency"), "unsupported_human_error_frequency_claim"),
    )


def statistic_violations(sections: DataFrame) -> DataFrame:
    """Tokens that no statistic has replaced, and lines that give a project's numbers without marking them."""
    tokens = sections.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(r"\{\{STAT:([A-Za-z0-9_.-]+)\}\}"), F.lit(1))).alias("ref")).distinct()
    lines = sections.select(*KEY, F.explode(F.split("body", "\n")).alias("line"))
    # What a project's numbers are about, and how they are counted.
    bare = lines.filter(~F.ltrim("line").startswith(">") & F.col("line").rlike("本(?:项目|次|文)|全文|段落|审校|复用|术语|发现") & F.col("line").rlike(r"\d+(?:\.\d+)?(?:%|段|条|处|次)") & ~F.contains("line", F.lit("<!--stat:")))
    return _all(_rule(tokens, "unresolved_statistic_token"), _rule(bare, "unmarked_project_statistic", "warning"))


def first_section_of(violations: DataFrame, sections: DataFrame) -> DataFrame:
    """Violations of a whole report, each with the first section whose body holds what it refers to."""
    held = references(sections).groupBy("doc_id", "ref").agg(F.min("seg_idx").alias("first"))
    return violations.join(held, ["doc_id", "ref"], "left").withColumn("seg_idx", F.coalesce("seg_idx", "first")).drop("first")
