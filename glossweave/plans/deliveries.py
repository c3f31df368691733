"""Queries over jobs, their findings and their delivery; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import delivery
from glossweave.plans.catalogue import _G, _PAIRS, _match, query
from glossweave.sources import derived, jobs
from glossweave.sources.jobs import FINDING_SQL, JOB_SQL, RECORD_SQL

_R = f"WITH {_PAIRS}, {RECORD_SQL}"
_RF = f"{_R}, {FINDING_SQL}"
_RFJ = f"{_RF}, {JOB_SQL}"
_SEVERE = "severity IN ('blocking', 'actionable')"


@query(f"{_RF} SELECT conv_id, seg_idx, source, target FROM rec WHERE reviewed AND NOT stale AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.conv_id = rec.conv_id AND fd.seg_idx = rec.seg_idx AND {_SEVERE} AND (NOT resolved OR action IN ('accepted_risk', 'human_fixed')))")
def tmx_eligible(spark, d):
    return delivery.trusted(jobs.records(spark, d), jobs.findings(spark, d)).select("conv_id", "seg_idx", "source", "target")


@query(f"WITH {FINDING_SQL} SELECT conv_id, severity, count(*) AS n, min(event_id) AS first_finding FROM fd WHERE NOT resolved AND {_SEVERE} GROUP BY ALL")
def unresolved_findings(spark, d):
    return delivery.unresolved(jobs.findings(spark, d)).groupBy("conv_id", "severity").agg(F.count("*").alias("n"), F.min("event_id").alias("first_finding"))


@query(f"WITH {FINDING_SQL} SELECT event_id, conv_id, resolved OR event_id % 5 = 0 AS resolved, CASE WHEN NOT resolved AND event_id % 5 = 0 THEN 'human_fixed' ELSE action END AS action, NOT resolved AND event_id % 5 = 0 AS marked FROM fd")
def mark_findings(spark, d):
    ids = derived.table(spark, d, "events").filter("event_id % 5 = 0").select("event_id")
    return delivery.mark(jobs.findings(spark, d), ids, "human_fixed").select("event_id", "conv_id", "resolved", "action", "marked")


_OPEN = "op AS (SELECT conv_id, count(*) AS n FROM fd WHERE NOT resolved AND severity = 'blocking' GROUP BY conv_id)"


@query(f"""{_RFJ}, {_OPEN} SELECT conv_id, CASE WHEN coalesce(n, 0) > 0 AND conv_id % 2 = 1 THEN 'refused' ELSE 'final' END AS outcome, coalesce(n, 0) AS blockers,
CASE WHEN coalesce(n, 0) > 0 AND conv_id % 2 = 1 THEN 0 ELSE coalesce(n, 0) END AS accepted FROM job LEFT JOIN op USING (conv_id)""")
def approve_delivery(spark, d):
    return delivery.approve(jobs.jobs(spark, d), jobs.findings(spark, d), accept_blocking=F.col("conv_id") % 2 == 0)


@query(f"{_RFJ}, {_OPEN} SELECT conv_id, CASE WHEN NOT p2_done THEN 'draft' WHEN n > 0 THEN 'review_required' WHEN approved THEN 'approved' ELSE 'draft' END AS delivery_status FROM job LEFT JOIN op USING (conv_id)")
def delivery_states(spark, d):
    return delivery.status(jobs.jobs(spark, d), jobs.findings(spark, d))


@query(f"""{_RFJ}, {_OPEN} SELECT conv_id, CASE WHEN NOT p1_done THEN 'INGESTED' WHEN NOT p2_done AND (frozen OR bypass) THEN 'TRANSLATING' WHEN NOT p2_done AND has_terms THEN 'TERMS_PREPARED' WHEN NOT p2_done THEN 'PROFILED'
WHEN n > 0 THEN 'REVIEW_REQUIRED' WHEN academic = 'failed' OR quality = 'fail' THEN 'ACADEMIC_FAILED' WHEN quality = 'review_required' THEN 'ACADEMIC_REVIEW_REQUIRED' WHEN academic = 'in_progress' THEN 'ACADEMIC_WRITING'
WHEN p3_done THEN 'REPORT_GENERATED' WHEN annotations_done THEN 'ANNOTATED' ELSE 'TRANSLATED' END AS stage FROM job LEFT JOIN op USING (conv_id)""")
def job_stages(spark, d):
    return delivery.stage(jobs.jobs(spark, d), jobs.records(spark, d), jobs.findings(spark, d))


@query(f"{_RFJ} SELECT conv_id FROM job WHERE strict AND NOT frozen AND NOT bypass AND EXISTS (SELECT 1 FROM fd WHERE fd.conv_id = job.conv_id AND type = 'signup')")
def freeze_gate(spark, d):
    # a strict job with candidates stops until its glossary is frozen or the freeze is bypassed
    candidates = jobs.findings(spark, d).filter("type = 'signup'").select("conv_id").distinct()
    return jobs.jobs(spark, d).filter("strict AND NOT frozen AND NOT bypass").join(candidates, "conv_id", "left_semi").select("conv_id")


_STATS = "sum((severity = 'blocking')::INT)::BIGINT AS blocking, sum((severity = 'actionable')::INT)::BIGINT AS actionable, sum((severity = 'informational')::INT)::BIGINT AS informational"


@query(f"WITH {FINDING_SQL} SELECT conv_id, 'translated' AS phase, {_STATS} FROM fd GROUP BY conv_id UNION ALL SELECT conv_id, 'retranslated', {_STATS} FROM fd WHERE NOT resolved GROUP BY conv_id")
def review_stats(spark, d):
    f = jobs.findings(spark, d)
    phases = [delivery.stats(f, "conv_id", open_only=o).withColumn("phase", F.lit(name)) for name, o in (("translated", False), ("retranslated", True))]
    return phases[0].unionByName(phases[1])


@query(f"""{_RF}, redo AS (SELECT DISTINCT conv_id, seg_idx FROM rec WHERE (conv_id + seg_idx) % 3 = 0),
a AS (SELECT event_id, fd.conv_id, fd.seg_idx, type, severity, resolved, action, redo.conv_id IS NOT NULL AND NOT resolved AND {_SEVERE} AS now FROM fd LEFT JOIN redo USING (conv_id, seg_idx))
SELECT event_id, conv_id, seg_idx, type, severity, resolved OR now AS resolved, CASE WHEN now THEN 'retranslated' ELSE action END AS action FROM a
UNION ALL SELECT NULL, conv_id, seg_idx, 'blank', 'blocking', false, NULL FROM redo WHERE conv_id % 5 = 0""")
def retranslate_overwrite(spark, d):
    redo = jobs.records(spark, d).filter("(conv_id + seg_idx) % 3 = 0").select("conv_id", "seg_idx")
    found = redo.filter("conv_id % 5 = 0").select("conv_id", "seg_idx", F.lit("blank").alias("type"), F.lit("blocking").alias("severity"))
    return delivery.retranslate(jobs.findings(spark, d), redo, found).select("event_id", "conv_id", "seg_idx", "type", "severity", "resolved", "action")


_MEMORY = "mem AS (SELECT source, min(target) AS target FROM pairs WHERE conv_id % 3 <> 0 GROUP BY source), new AS (SELECT source, arg_max(target, conv_id * 100 + seg_idx) AS new_target FROM pairs WHERE conv_id % 2 = 0 GROUP BY source)"


@query(f"""WITH {_PAIRS}, {_MEMORY} SELECT coalesce(mem.source, new.source) AS source, coalesce(new_target, target) AS target,
CASE WHEN target IS NULL THEN 'added' WHEN new_target IS NULL THEN 'kept' WHEN target = new_target THEN 'same' ELSE 'changed' END AS state FROM mem FULL JOIN new ON mem.source = new.source""")
def tm_upsert(spark, d):
    own = jobs.records(spark, d)
    memory = own.filter("conv_id % 3 <> 0").groupBy("source").agg(F.min("target").alias("target"))
    return delivery.upsert(memory, own.filter("conv_id % 2 = 0").select("source", "target", (F.col("conv_id") * 100 + F.col("seg_idx")).alias("pos")))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][A-Za-z]{5,}')) AS source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'd' || doc_id END AS target FROM documents)
SELECT lower(source) AS key, arg_min(source, doc_id) AS source, arg_min(target, doc_id) FILTER (WHERE trim(target) <> '') AS target, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS occurrences FROM (SELECT DISTINCT ON (doc_id, lower(source)) doc_id, min(source) OVER (PARTITION BY doc_id, lower(source)) AS source, target FROM w) GROUP BY 1""")
def knowledge_merge(spark, d):
    w = derived.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]{5,}"), F.lit(0))).alias("source"))
    once = w.groupBy("doc_id", F.lower("source").alias("k")).agg(F.min("source").alias("source"))
    target = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), "doc_id"))
    return delivery.merge_candidates(once.select("source", target.alias("target"), F.col("doc_id").alias("segment"))).select("key", "source", "target", F.array_join("occurrences", ",").alias("occurrences"))


# A glossary of two versions: the first is the derived one, in the second a term binds that was provisional, and one is rendered otherwise


def _current(glossary):
    preferred = F.when(F.col("id") == "t1", "den").otherwise(F.col("preferred"))
    return glossary.withColumn("preferred", preferred).withColumn("status", F.when(F.col("id") == "t7", "locked").otherwise(F.col("status"))).filter("id <> 't6'")


_CURRENT = "cur AS (SELECT * REPLACE (CASE WHEN id = 't1' THEN 'den' ELSE preferred END AS preferred, CASE WHEN id = 't7' THEN 'locked' ELSE status END AS status) FROM g WHERE id <> 't6')"
_KEYED = "concat_ws('|', preferred, array_to_string(list_sort(forbidden), ','), behavior, status)"
_STALE = f"""{_R}, {_G}, {_CURRENT}, rh AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'h1' END AS h FROM rec),
st AS (SELECT DISTINCT conv_id, seg_idx FROM (
SELECT rh.conv_id, rh.seg_idx FROM rh JOIN g ON h = 'h1' AND g.id IN ('t1', 't' || (seg_idx % 9 + 1)) JOIN cur ON lower(cur.source) = lower(g.source) WHERE {_KEYED.replace("preferred", "g.preferred").replace("forbidden", "g.forbidden").replace("behavior", "g.behavior").replace("status", "g.status")} <> {_KEYED.replace("preferred", "cur.preferred").replace("forbidden", "cur.forbidden").replace("behavior", "cur.behavior").replace("status", "cur.status")} AND {_match("g.source", "rh.source")}
UNION ALL SELECT conv_id, seg_idx FROM rh JOIN cur ON (cur.behavior = 'preserve' OR cur.status = 'locked') AND {_match("cur.source", "rh.source")} WHERE NOT (h IS NOT NULL AND lower(cur.source) IN (SELECT lower(source) FROM g WHERE behavior = 'preserve' OR status = 'locked'))))"""


def _stale(spark, d):
    own = jobs.records(spark, d).withColumn("glossary_hash", F.when(F.col("conv_id") % 2 == 0, "h1"))
    used = own.select("conv_id", "seg_idx", F.explode(F.array_distinct(F.array(F.lit("t1"), F.concat(F.lit("t"), F.col("seg_idx") % 9 + 1)))).alias("entry_id"))
    glossary = derived.glossary(spark)
    return own, delivery.stale_segments(own, used, glossary.withColumn("glossary_hash", F.lit("h1")), _current(glossary))


@query(f"{_STALE} SELECT conv_id, seg_idx FROM st")
def glossary_stale_segments(spark, d):
    return _stale(spark, d)[1]


@query(f"""{_STALE} SELECT conv_id, seg_idx, st.conv_id IS NOT NULL AS stale, reviewed AND st.conv_id IS NULL AS reviewed, from_tm AND st.conv_id IS NULL AS from_tm, human_accepted AND st.conv_id IS NULL AS human_accepted,
CASE WHEN st.conv_id IS NULL THEN provenance END AS provenance FROM rec LEFT JOIN st USING (conv_id, seg_idx)""".replace("st.conv_id IS", "st.k IS").replace("st AS (SELECT DISTINCT conv_id, seg_idx FROM", "st AS (SELECT DISTINCT conv_id, seg_idx, 1 AS k FROM"))
def staleness_updates(spark, d):
    own, stale = _stale(spark, d)
    return delivery.apply_staleness(own.drop("glossary_hash"), stale)


@query(f"""{_STALE}, {FINDING_SQL}, dirty AS (SELECT DISTINCT source FROM rec JOIN st USING (conv_id, seg_idx)), mem AS (SELECT source, min(target) AS target FROM pairs GROUP BY source)
SELECT * FROM mem WHERE source NOT IN (SELECT source FROM dirty)""")
def tm_delete_stale(spark, d):
    own, stale = _stale(spark, d)
    memory = own.groupBy("source").agg(F.min("target").alias("target"))
    return memory.join(own.join(stale, ["conv_id", "seg_idx"], "left_semi").select("source").distinct(), "source", "left_anti")


@query(f"""{_STALE}, {FINDING_SQL}, al AS (SELECT conv_id, severity FROM fd UNION ALL SELECT conv_id, 'blocking' FROM st) SELECT conv_id, {_STATS} FROM al GROUP BY conv_id""")
def staleness_review_stats(spark, d):
    _, stale = _stale(spark, d)
    return delivery.stats(delivery.staleness_findings(jobs.findings(spark, d), stale), "conv_id", open_only=False)


@query(r"""WITH w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][A-Za-z]{5,}'))) AS key FROM documents) SELECT key, count(*) AS n FROM w GROUP BY key HAVING sum((doc_id % 17 = 0)::INT) = 0""")
def retracted_candidates(spark, d):
    w = derived.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]{5,}"), F.lit(0))).alias("source"))
    merged = delivery.merge_candidates(w.select("source", F.lit("").alias("target"), F.col("doc_id").alias("segment")))
    invalid = derived.table(spark, d, "documents").filter("doc_id % 17 = 0").select(F.col("doc_id").alias("segment"))
    return delivery.retract(merged, invalid).select("key", F.size("occurrences").cast("long").alias("n"))


@query(f"""{_RF}, n AS (SELECT conv_id, seg_idx, count(*) FILTER (WHERE {_SEVERE}) AS dt, count(*) FILTER (WHERE {_SEVERE} AND conflict) AS bl FROM fd WHERE NOT resolved GROUP BY ALL),
o AS (SELECT conv_id, seg_idx, target, initial_target, CASE WHEN conv_id % 11 = 0 THEN 'candidate_hash_mismatch' WHEN conv_id % 7 = 0 THEN 'input_hash_mismatch' WHEN seg_idx = 4 THEN 'blind_review_identity_mismatch' WHEN coalesce(dt, 0) > 3 THEN 'deterministic_qa' WHEN conv_id % 5 = 0 THEN 'blind_review_failed' WHEN coalesce(bl, 0) > 0 THEN 'blind_review' END AS rejection
FROM rec LEFT JOIN n USING (conv_id, seg_idx) WHERE initial_target IS NOT NULL)
SELECT conv_id, seg_idx, rejection, CASE WHEN rejection IS NULL THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN rejection IS NULL THEN target ELSE initial_target END AS promoted FROM o""")
def repair_precedence(spark, d):
    own = jobs.records(spark, d).filter("initial_target IS NOT NULL")
    severe = delivery.unresolved(jobs.findings(spark, d))
    n = severe.groupBy("conv_id", "seg_idx").agg(F.count("*").alias("dt"), F.sum(F.col("conflict").cast("int")).alias("bl"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    wrong = lambda on, x: F.when(on, "changed").otherwise(x)
    shadow = F.sha2("target", 256)
    rows = own.join(n, ["conv_id", "seg_idx"], "left").select(
        "conv_id", "seg_idx", "source", F.col("initial_target").alias("formal"), F.col("target").alias("shadow"), wrong(F.col("conv_id") % 11 == 0, shadow).alias("candidate_hash"),
        wrong(F.col("conv_id") % 7 == 0, F.sha2(F.concat_ws("|", "source", "initial_target"), 256)).alias("input_hash"), F.when(F.col("seg_idx") == 4, "another").alias("reviewed_hash"),
        F.when(zero("dt") > 3, 1).otherwise(0).alias("deterministic"), (F.col("conv_id") % 5 == 0).alias("blind_failed"), zero("bl").alias("blind"),
    )
    return delivery.overlays(rows).select("conv_id", "seg_idx", "rejection", "status", "promoted")


_LEVEL = "CASE WHEN human_accepted OR provenance IN ('human', 'human_accepted') THEN 'human_accepted' WHEN reviewed AND (from_tm OR provenance = 'tm_approved') THEN 'tm_approved' WHEN reviewed OR provenance = 'reviewed' THEN 'reviewed' ELSE 'generated' END"


@query(f"{_R} SELECT {_LEVEL} AS level, count(*) AS n, min(conv_id) AS first_job FROM rec GROUP BY 1")
def target_context_levels(spark, d):
    return jobs.records(spark, d).groupBy(delivery.context_level().alias("level")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_job"))


@query(rf"""{_R}, l AS (SELECT *, {_LEVEL} AS level, list_position(['human_accepted', 'tm_approved', 'reviewed', 'generated'], {_LEVEL}) AS rank, substring(regexp_replace(trim(target, ' '), '\s+', ' ', 'g'), 1, 1200) AS clip FROM rec WHERE trim(target, ' ') <> ''),
n AS (SELECT a.conv_id, a.seg_idx, b.seg_idx AS of, b.level, b.clip AS text, row_number() OVER (PARTITION BY a.conv_id, a.seg_idx ORDER BY b.rank, b.seg_idx DESC) AS r FROM l a JOIN l b ON a.conv_id = b.conv_id AND b.seg_idx < a.seg_idx) SELECT conv_id, seg_idx, of, level, text FROM n WHERE r <= 2""")
def context_ranked_targets(spark, d):
    return delivery.target_context(jobs.records(spark, d))
