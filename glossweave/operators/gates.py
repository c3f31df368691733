"""Gates that a made-up case must pass to stand in a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.python import meaningful_revision

#: The gates in their order.
GATES = (
    "real_source_exists", "opportunity_grounded", "baseline_plausible", "diagnosis_evidence_backed", "error_confirmed", "repair_confirmed", "repair_value_confirmed", "repair_traceable", "meaningful_contrast", "baseline_not_already_correct",
    "no_unrelated_meaning_change",
)


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _within(part: str, whole: str) -> Column:
    """Whether a part that isn't empty lies within a text, whatever its case; ß is SS."""
    folded = lambda x: F.upper(F.translate(x, "ẞ", "ß"))
    return _said(part) & F.contains(folded(F.coalesce(whole, F.lit(""))), folded(F.col(part)))


def gated(cases: DataFrame, segments: DataFrame) -> DataFrame:
    """``cases`` with ``failed`` (the gates that it doesn't pass, in order), ``first_failed`` and ``eligible``, all gates passed.

    cases(case_id, segment_id, source_text, trigger, reason, plausibility, grounding, materiality_check, correctness, value, already_correct, unrelated_change, baseline, optimized, error_id, materiality,
    diagnosis, error_span, repairs, decision, addresses); segments(segment_id, source), one row each. What is missing fails its gate; a verdict on the baseline or on
    unrelated changes that is missing counts as a bad one."""
    c = F.col
    own = cases.join(segments.select("segment_id", c("source").alias("__source")), "segment_id", "left").withColumn("__changed", meaningful_revision("baseline", "optimized"))
    passed = dict(
        zip(
            GATES,
            (
                _said("source_text") & c("__source").isNotNull() & F.contains("__source", "source_text"), _said("reason") & _within("trigger", "source_text"), c("plausibility") == "plausible",
                (c("grounding") == "confirmed") & _within("error_span", "source_text"), (c("materiality_check") == "confirmed") & c("materiality").isin("major", "moderate") & _said("diagnosis"), c("correctness") == "confirmed", c("value") == "confirmed",
                _said("error_id") & c("repairs").eqNullSafe(c("error_id")) & _said("decision") & _said("addresses"), c("__changed"), ~F.coalesce("already_correct", F.lit(True)), ~F.coalesce("unrelated_change", F.lit(True)),
            ),
            strict=True,
        )
    )
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in passed.items()]))
    return own.withColumn("failed", failed).withColumn("first_failed", F.get("failed", F.lit(0))).withColumn("eligible", F.size("failed") == 0).drop("__source", "__changed")


def gate_metrics(cases: DataFrame) -> DataFrame:
    """Over ``gated`` cases: baselines made, those that aren't plausible, plausible ones whose error isn't confirmed, repairs that aren't, and eligible cases."""
    fails = lambda *names: F.arrays_overlap("failed", F.array(*map(F.lit, names)))
    plausible = F.col("plausibility") == "plausible"
    return cases.agg(
        F.count_if(_said("baseline")).alias("baselines"), F.count_if(_said("baseline") & ~F.coalesce(plausible, F.lit(False))).alias("implausible"), F.count_if(plausible & fails("error_confirmed")).alias("not_material"),
        F.count_if(_said("optimized") & fails("repair_confirmed", "repair_value_confirmed")).alias("repairs_rejected"), F.count_if("eligible").alias("eligible"),
    )
