"""The delivery cycle: which pairs are trusted, how findings are settled, what a retranslation or a new glossary undoes.

Findings are rows (conv_id, seg_idx, type, severity, resolved, action, ...); a job is a conversation. Every change of state is
a join with the rows that change, so a job with any number of findings is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.operators.matching import term_matches_in

SEVERE = ("blocking", "actionable")
#: Settled so, a finding doesn't make its pair trusted.
UNTRUSTED = ("accepted_risk", "human_fixed")
KEY = ["conv_id", "seg_idx"]


def unresolved(findings: DataFrame, *severities: str) -> DataFrame:
    return findings.filter(~F.col("resolved") & F.col("severity").isin(*(severities or SEVERE)))


def trusted(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs fit for the final memory: reviewed, not stale, no open severe finding and none that a person waved through."""
    bad = findings.filter(F.col("severity").isin(*SEVERE) & (~F.col("resolved") | F.col("action").isin(*UNTRUSTED)))
    return records.filter(F.col("reviewed") & ~F.col("stale")).join(bad.select(*KEY).distinct(), KEY, "left_anti")


def mark(findings: DataFrame, ids: DataFrame, action: str, *, id_col: str = "event_id") -> DataFrame:
    """``findings`` with those of ``ids`` that are open resolved by ``action``; ``marked`` says which."""
    hit = findings.join(ids.select(id_col).distinct().withColumn("__hit", F.lit(True)), id_col, "left")
    now = F.coalesce("__hit", F.lit(False)) & ~F.col("resolved")
    return hit.select(*[c for c in findings.columns if c not in ("resolved", "action")], (F.col("resolved") | now).alias("resolved"), F.when(now, action).otherwise(F.col("action")).alias("action"), now.alias("marked"))


def approve(jobs: DataFrame, findings: DataFrame, *, accept_blocking: Column) -> DataFrame:
    """Per job: final, or refused for its open blocking findings unless ``accept_blocking``, which makes those accepted risks."""
    open_ = unresolved(findings, "blocking").groupBy("conv_id").agg(F.count("*").alias("blockers"))
    n = F.coalesce("blockers", F.lit(0))
    status = F.when((n > 0) & ~accept_blocking, "refused").otherwise("final")
    return jobs.join(open_, "conv_id", "left").select("conv_id", status.alias("outcome"), n.alias("blockers"), F.when(status == "final", n).otherwise(0).alias("accepted"))


def status(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per job: draft before it is translated, review_required with open blocking findings, and approved only if a person approved it."""
    open_ = unresolved(findings, "blocking").select("conv_id").distinct().withColumn("blocked", F.lit(True))
    state = F.when(~F.col("p2_done"), "draft").when(F.col("blocked"), "review_required").when(F.col("approved"), "approved").otherwise("draft")
    return jobs.join(open_, "conv_id", "left").select("conv_id", state.alias("delivery_status"))


def stage(jobs: DataFrame, pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per job: how far its milestones say it has come."""
    with_pairs = pairs.select("conv_id").distinct().withColumn("started", F.lit(True))
    blocked = unresolved(findings, "blocking").select("conv_id").distinct().withColumn("blocked", F.lit(True))
    c = F.col
    # The names of the stages.
    name = (
        F.when(~c("p1_done"), "INGESTED").when(~c("p2_done") & c("started") & (c("frozen") | c("bypass")), "TRANSLATING").when(~c("p2_done") & c("frozen"), "GLOSSARY_FROZEN")
        .when(~c("p2_done") & c("has_terms"), "TERMS_PREPARED").when(~c("p2_done"), "PROFILED").when(c("blocked"), "REVIEW_REQUIRED").when((c("academic") == "failed") | (c("quality") == "fail"), "ACADEMIC_FAILED")
        .when(c("quality") == "review_required", "ACADEMIC_REVIEW_REQUIRED").when(c("academic") == "in_progress", "ACADEMIC_WRITING").when(c("p3_done"), "REPORT_GENERATED").when(c("annotations_done"), "ANNOTATED").otherwise("TRANSLATED")
    )
    return jobs.join(with_pairs, "conv_id", "left").join(blocked, "conv_id", "left").select("conv_id", name.alias("stage"))


def stats(findings: DataFrame, *keys: str, open_only: bool) -> DataFrame:
    """Findings of each severity: all as translated, or the open ones as after a retranslation."""
    n = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(s)
    return (findings.filter(~F.col("resolved")) if open_only else findings).groupBy(*keys).agg(n("blocking"), n("actionable"), n("informational"))


def retranslate(findings: DataFrame, segments: DataFrame, found: DataFrame) -> DataFrame:
    """``findings`` after ``segments`` (conv_id, seg_idx) were translated anew: their open severe ones are closed, ``found`` joins."""
    redone = segments.select(*KEY).distinct().withColumn("__redone", F.lit(True))
    hit = findings.join(redone, KEY, "left")
    now = F.coalesce("__redone", F.lit(False)) & ~F.col("resolved") & F.col("severity").isin(*SEVERE)
    closed = hit.select(*[c for c in findings.columns if c not in ("resolved", "action")], (F.col("resolved") | now).alias("resolved"), F.when(now, "retranslated").otherwise(F.col("action")).alias("action"))
    new = found.join(segments.select(*KEY).distinct(), KEY, "left_semi").withColumn("resolved", F.lit(False)).withColumn("action", F.lit(None).cast("string"))
    return closed.unionByName(new, allowMissingColumns=True)


def upsert(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """``memory`` (source, target) with the targets of ``rows`` (source, target, pos), the last of each source, in place of its own."""
    new = rows.groupBy("source").agg(F.max_by("target", "pos").alias("new_target"))
    both = memory.join(new, "source", "full_outer")
    state = F.when(F.col("target").isNull(), "added").when(F.col("new_target").isNull(), "kept").when(F.col("target") == F.col("new_target"), "same").otherwise("changed")
    return both.select("source", F.coalesce("new_target", "target").alias("target"), state.alias("state"))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Rows (source, target, segment) of one source whatever its case: its segments united, the first target that isn't blank."""
    named = F.when(F.trim("target") != "", F.struct("segment", "target"))
    return candidates.groupBy(F.lower("source").alias("key")).agg(F.min_by("source", "segment").alias("source"), F.min(named)["target"].alias("target"), F.array_sort(F.collect_set("segment")).alias("occurrences"))


def semantics(prefix: str = "") -> Column:
    """What of a glossary entry binds a translation."""
    c = lambda x: F.col(prefix + x)
    return F.concat_ws("|", F.coalesce(c("preferred"), F.lit("")), F.array_join(F.array_sort(c("forbidden")), ","), c("behavior"), c("status"))


def stale_segments(records: DataFrame, used: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs that a new glossary affects.

    ``records`` have the ``glossary_hash`` they were translated under, or null; ``used`` (conv_id, seg_idx, entry_id) the entries
    that were given to them. A pair is stale if an entry that it was given, whose term it holds, binds otherwise now; or if it
    holds a term that binds now and didn't under its version."""
    enforced = (F.col("behavior") == "preserve") | (F.col("status") == "locked")
    now = current.select(F.lower("source").alias("k"), semantics().alias("now"))
    then = versions.select("glossary_hash", F.col("id").alias("entry_id"), F.col("source").alias("term"), F.lower("source").alias("k"), semantics().alias("then"))
    changed = then.join(now, "k").filter("then <> now").select("glossary_hash", "entry_id", "term")
    given = records.join(used, KEY).join(changed.select("glossary_hash", "entry_id").distinct(), ["glossary_hash", "entry_id"], "left_semi")
    holding = term_matches_in(given.select(*KEY, "source", "glossary_hash", "entry_id"), changed.select(F.col("term").alias("term"), F.col("entry_id").alias("id"), F.col("glossary_hash").alias("h")), text_col="source", term_col="term", keep=[*KEY, "glossary_hash", "entry_id"])
    first = holding.filter("id = entry_id AND h = glossary_hash").select(*KEY)
    binding = current.filter(enforced).select(F.col("source").alias("term"), F.lower("source").alias("k"))
    bound = versions.filter(enforced).select(F.col("glossary_hash").alias("glossary_hash"), F.lower("source").alias("k")).distinct()
    met = term_matches_in(records, binding, text_col="source", term_col="term", keep=[*KEY, "glossary_hash"])
    second = met.join(bound, ["glossary_hash", "k"], "left_anti").select(*KEY)
    return first.unionByName(second).distinct()


def apply_staleness(records: DataFrame, stale: DataFrame) -> DataFrame:
    """``records`` anew: stale pairs lose their review, their memory link and their provenance; the others lose the mark only."""
    hit = records.drop("stale").join(stale.select(*KEY).distinct().withColumn("__stale", F.lit(True)), KEY, "left")
    now = F.coalesce("__stale", F.lit(False))
    off = lambda c: (F.col(c) & ~now).alias(c)
    return hit.select(*KEY, now.alias("stale"), off("reviewed"), off("from_tm"), off("human_accepted"), F.when(~now, F.col("provenance")).alias("provenance"))


def staleness_findings(findings: DataFrame, stale: DataFrame) -> DataFrame:
    """``findings`` without earlier marks of staleness, and a blocking one for each stale pair."""
    new = stale.select(*KEY, F.lit("glossary_stale").alias("type"), F.lit("blocking").alias("severity"), F.lit(False).alias("resolved"))
    return findings.filter("type <> 'glossary_stale'").unionByName(new, allowMissingColumns=True)


def retract(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates (key, occurrences) of which no occurrence is among ``segments`` (segment)."""
    touched = candidates.select("key", F.explode("occurrences").alias("segment")).join(segments, "segment", "left_semi").select("key").distinct()
    return candidates.join(touched, "key", "left_anti")


def overlays(rows: DataFrame) -> DataFrame:
    """Repair overlays with the first reason that rejects each, or accepted, and the target that stands."""
    c = F.col
    why = (
        F.when(F.sha2("shadow", 256) != c("candidate_hash"), "candidate_hash_mismatch").when(F.sha2(F.concat_ws("|", "source", "formal"), 256) != c("input_hash"), "input_hash_mismatch")
        .when(c("reviewed_hash").isNotNull() & (c("reviewed_hash") != c("candidate_hash")), "blind_review_identity_mismatch").when(c("deterministic") > 0, "deterministic_qa").when(c("blind_failed"), "blind_review_failed").when(c("blind") > 0, "blind_review")
    )
    return rows.withColumn("rejection", why).withColumn("status", F.when(c("rejection").isNull(), "accepted").otherwise("rejected")).withColumn("promoted", F.when(c("rejection").isNull(), c("shadow")).otherwise(c("formal")))


def context_level() -> Column:
    """How far a pair's target can be trusted as context, the strongest first."""
    c = F.col
    return F.when(c("human_accepted") | c("provenance").isin("human", "human_accepted"), "human_accepted").when(c("reviewed") & (c("from_tm") | (c("provenance") == "tm_approved")), "tm_approved").when(c("reviewed") | (c("provenance") == "reviewed"), "reviewed").otherwise("generated")


LEVELS = ("human_accepted", "tm_approved", "reviewed", "generated")


def target_context(records: DataFrame, *, limit: int = 2, chars: int = 1200) -> DataFrame:
    """As of each pair, of the targets before it in its job those of the strongest level, the latest of each first, and ``limit`` in all; in
    their order.

    Of each level only the last ``limit`` before a pair can be chosen, so each pair carries ``limit`` rows of each level and not all before it."""
    w = Window.partitionBy("conv_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    text = F.substring(F.regexp_replace(F.trim("target"), r"\s+", " "), 1, chars)
    own = records.filter(F.trim("target") != "").withColumn("level", context_level())
    # the last of each level as running values: nth before is found by joining on the count so far
    rank = {name: k for k, name in enumerate(LEVELS)}
    own = own.withColumn("rank", F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("level")])
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "rank").orderBy("seg_idx")))
    seen = own.select(*KEY, *[F.sum((F.col("rank") == k).cast("int")).over(w).alias(f"n{k}") for k in range(len(LEVELS))])
    def last(k: int) -> Column:
        """The places that the last of level ``k`` have among those of their level."""
        back = F.sequence(F.lit(0), F.lit(limit - 1))
        return F.transform(back, lambda x: F.struct(F.lit(k).alias("rank"), (F.coalesce(f"n{k}", F.lit(0)) - x).cast("int").alias("nth")))

    wanted = F.flatten(F.array(*map(last, range(len(LEVELS)))))
    asked = seen.select(*KEY, F.explode(F.slice(F.filter(wanted, lambda x: x["nth"] > 0), 1, limit)).alias("at")).select(*KEY, "at.rank", "at.nth")
    found = asked.join(own.select("conv_id", "rank", "nth", F.col("seg_idx").alias("of"), "level", text.alias("text")), ["conv_id", "rank", "nth"])
    return found.select(*KEY, "of", "level", "text")
