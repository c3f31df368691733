"""Human evidence: what to ask an author about a case, how to take the answer, and what it lets a case support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The dimensions of a case's analysis in which a gap can be asked about, and which answers carry a reason.
ASKED_OF_SYNTHETIC = {"synthetic_baseline_plausibility": ("initial_failure_or_alternative", "initial_solution_or_failure", "alternative_interpretation_or_strategy"), "synthetic_optimization_preference": ("decision_rationale", "final_translation_decision", "translation_effect", "bounded_conclusion", "case_level_conclusion")}
REASONS = ("translator_rationale", "repair_reason", "review_acceptance_reason", "terminology_decision_reason")
VALUES = ("critical", "high", "medium", "low")
UNAVAILABLE = r"(?i)^(?:不知道|不记得|不记得了|忘记了|忘了|没印象|没有特别考虑|没有相关记录|没有记录|没想过|不确定|想不起来|don'?t (?:know|remember)|not sure|no (?:specific )?(?:reason|record|memory)|can'?t recall)[。！？!?]?$"
QUOTED = r"[“\"'『「]([^”\"'』」]{2,80})[”\"'』」]"


def need(dimension: Column, synthetic: Column, available: Column, changed: Column) -> Column:
    """What evidence a gap in a dimension asks for."""
    c = F.when(synthetic & dimension.isin(*ASKED_OF_SYNTHETIC["synthetic_baseline_plausibility"]), "synthetic_baseline_plausibility").when(synthetic & dimension.isin(*ASKED_OF_SYNTHETIC["synthetic_optimization_preference"]), "synthetic_optimization_preference")
    c = c.when(dimension == "decision_rationale", F.when(changed, "repair_reason").otherwise("translator_rationale")).when(dimension == "translation_effect", "reader_response")
    c = c.when(dimension == "initial_failure_or_alternative", F.when(~available | ~changed, "initial_translation_missing").otherwise("alternative_considered"))
    return c.when(dimension == "theory_mapping", "theoretical_intention").when(dimension == "evidence_use", "reviewer_feedback").when(dimension == "bounded_conclusion", "translator_rationale").otherwise("other_author_context")


def recoverability(kind: Column, available: Column, has_initial: Column, has_findings: Column) -> Column:
    """Where such evidence can still come from."""
    asked = ("translator_rationale", "repair_reason", "alternative_considered", "reader_response", "source_interpretation", "theoretical_intention", "context_information", "terminology_decision_reason", *ASKED_OF_SYNTHETIC)
    return (
        F.when((kind == "initial_translation_missing") & available & has_initial, "system_recoverable").when((kind == "initial_translation_missing") & ~has_initial, "historically_unrecoverable").when(kind == "initial_translation_missing", "human_recoverable")
        .when(kind == "reviewer_feedback", F.when(has_findings, "system_recoverable").otherwise("not_worth_requesting")).when(kind == "review_acceptance_reason", F.when(has_findings, "human_recoverable").otherwise("historically_unrecoverable"))
        .when(kind.isin(*asked), "human_recoverable").otherwise("not_worth_requesting")
    )


def value(kind: Column, dimension: Column, blocks: Column) -> Column:
    """How much an answer is worth."""
    strong = kind.isin("translator_rationale", "repair_reason", "reader_response", "alternative_considered", *ASKED_OF_SYNTHETIC)
    central = dimension.isin("decision_rationale", "translation_effect", "bounded_conclusion")
    return F.when(blocks, "critical").when(strong & central, "high").when(strong, "medium").when(kind.isin("initial_translation_missing", "terminology_decision_reason"), "medium").otherwise("low")


def needs(gaps: DataFrame, *, per_case: int = 2) -> DataFrame:
    """gaps(case_id, dimension, synthetic, available, changed, has_initial, has_findings, urgent): what to ask, the first dimension of each kind of
    need of a case, the most valuable of a case, numbered."""
    c = F.col
    kind = need(c("dimension"), c("synthetic"), c("available"), c("changed"))
    own = gaps.filter("changed").withColumn("need", kind).filter(recoverability(c("need"), c("available"), c("has_initial"), c("has_findings")) == "human_recoverable")
    once = own.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "need").orderBy("dimension"))).filter("n = 1")
    once = once.withColumn("value", value(c("need"), c("dimension"), c("urgent") & c("dimension").isin("decision_rationale", "evidence_use")))
    order = Window.partitionBy("case_id").orderBy(F.array_position(F.array(*map(F.lit, VALUES)), c("value")), "dimension")
    return once.withColumn("n", F.row_number().over(order)).filter(c("n") <= per_case).select("case_id", "n", "need", "dimension", "value")


def answer_status(answer: Column) -> Column:
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", "needs_clarification").when(F.trim(answer).rlike(UNAVAILABLE), "unavailable_after_human_check").otherwise("user_confirmed")


def conflict(question: Column, answer: Column, initial: Column, final: Column) -> Column:
    """Whether what an answer quotes stands in the stored versions: consistent, not_corroborated or contradicted."""
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    a, b = flat(initial), flat(final)
    quoted = F.transform(F.regexp_extract_all(answer, F.lit(QUOTED), F.lit(1)), flat)
    strange = F.filter(quoted, lambda x: (x != "") & ~F.contains(a, x))
    asked = question.isin("initial_translation_missing", "repair_reason")
    return F.when((a == "") | (F.size(quoted) == 0), "not_corroborated").when(asked & (F.size(strange) > 0), F.when(F.contains(b, F.element_at(strange, 1)), "not_corroborated").otherwise("contradicted")).otherwise("consistent")


def current(answers: DataFrame) -> DataFrame:
    """answers(case_id, question, pos, ..) with ``status``: those that a later confirmed answer to the same question replaces are superseded."""
    last = F.max(F.when(F.col("status") == "user_confirmed", F.col("pos"))).over(Window.partitionBy("case_id", "question"))
    return answers.withColumn("status", F.when((F.col("status") == "user_confirmed") & (F.col("pos") < last), "superseded").otherwise(F.col("status")))


def capabilities(adequacy: DataFrame, answers: DataFrame) -> DataFrame:
    """adequacy(case_id, level, can, cannot, changed) with what confirmed answers (case_id, question, status) add to and take from it."""
    asked = answers.filter("status = 'user_confirmed'").groupBy("case_id").agg(F.collect_set("question").alias("asked"))
    own = adequacy.join(asked, "case_id", "left")
    some = F.col("changed") & F.col("asked").isNotNull()
    has = lambda *q: some & F.arrays_overlap("asked", F.array(*map(F.lit, q)))
    none = F.array().cast("array<string>")
    more = lambda on, *x: F.when(on, F.array(*map(F.lit, x))).otherwise(none)
    can = F.array_distinct(F.concat("can", more(has(*REASONS), "translator_rationale", "decision_reasoning"), more(has("reader_response"), "reader_response_claim"), more(has("synthetic_baseline_plausibility"), "author_judged_baseline_plausibility"), more(has("synthetic_optimization_preference"), "author_optimization_preference")))
    cannot = F.array_except("cannot", more(has(*REASONS), "process_claims", "historical_revision_reasoning"))
    level = F.when(some & (F.col("level") == "source_final_only"), "source_final_plus_author_rationale").otherwise(F.col("level"))
    return own.select("case_id", level.alias("level"), F.array_sort(can).alias("can"), F.array_sort(cannot).alias("cannot"))


def completion(plans: DataFrame) -> DataFrame:
    """Case plans (case_id and a boolean for each part) to the state of each of ten parts of the analysis contract, a row each."""
    c = F.col
    only = c("level") == "source_final_only"
    got = lambda x, yes="strong", no="missing": F.when(c(x), yes).otherwise(no)
    parts = {
        "translation_problem": F.when(c("problem") & c("grounded"), "strong").when(c("problem"), "weak").otherwise("missing"), "difficulty_evidence": F.when(c("changed"), "strong").when(only, "not_applicable").otherwise("weak"),
        "initial_solution_or_failure": F.when(c("failure"), "strong").when(only, "not_applicable").otherwise("missing"), "alternative_interpretation_or_strategy": got("alternatives", "adequate"), "final_translation_decision": got("rationale", no="weak"),
        "decision_rationale": got("rationale"), "translation_effect": got("effect"), "theory_connection": F.coalesce("theory", F.lit("not_applicable")), "evidence_boundary": got("boundary", "adequate", "weak"), "case_level_conclusion": got("conclusion"),
    }
    return plans.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("status")) for k, v in parts.items()])).alias("p")).select("case_id", "p.*")
