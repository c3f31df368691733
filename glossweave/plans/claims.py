"""Queries over what a report says of its cases; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions.python import contrast
from glossweave.operators import cases, diagnostics, gates, records
from glossweave.operators.diagnostics import REVISION, REVISION_PAIR
from glossweave.plans.catalogue import query
from glossweave.plans.qualities import at
from glossweave.plans.studies import _BASE, _REVISED
from glossweave.sources import jobs

# A section for each pair, about its own case: no claim, a bare claim, the change as it is stored, another one, two changes close together; some name no case.
_CASE = "'seg-' || conv_id || '-' || seg_idx"
_SAID = """CASE (conv_id + seg_idx) % 6 WHEN 0 THEN 'Nothing is said of it.' WHEN 1 THEN '经过修订，it reads well.' WHEN 2 THEN '将“' || coalesce(substring(replace(initial_target, chr(39), ' '), 1, 30), 'none') || '”改为“' || substring(replace(target, chr(39), ' '), 1, 30) || '”。'
WHEN 3 THEN '将“never stored”改为“' || substring(target, 1, 9) || '”。' WHEN 4 THEN '从“old here”改成“new here”，又将“one more”替换为“and another”。' ELSE '修改后' END"""
_SECTION = f"CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'In [' || {_CASE} || '] ' END || {_SAID} || ' ' || source"
# What a made-up case of each pair has; every gate is failed by some.
_MADE = {
    "source_text": "CASE WHEN (conv_id + seg_idx) % 23 = 1 THEN source || ' not there' ELSE source END", "trigger": "CASE (conv_id + seg_idx) % 29 WHEN 2 THEN '' WHEN 3 THEN 'never in it' ELSE upper(substring(source, 3, 9)) END", "reason": "CASE WHEN conv_id % 31 = 3 THEN '' ELSE 'a reason' END",
    "plausibility": "CASE conv_id % 7 WHEN 4 THEN 'implausible' WHEN 5 THEN 'borderline' ELSE 'plausible' END", "grounding": "CASE WHEN seg_idx % 8 = 6 THEN 'partial' ELSE 'confirmed' END", "materiality_check": "CASE WHEN (conv_id + seg_idx) % 9 = 6 THEN 'not_confirmed' ELSE 'confirmed' END",
    "correctness": "CASE WHEN conv_id % 11 = 6 THEN 'partial' ELSE 'confirmed' END", "value": "CASE WHEN conv_id % 13 = 7 THEN CAST(NULL AS STRING) ELSE 'confirmed' END", "already_correct": "conv_id % 17 = 8", "unrelated_change": "CASE conv_id % 19 WHEN 9 THEN true WHEN 10 THEN CAST(NULL AS BOOLEAN) ELSE false END",
    "baseline": "initial_target", "optimized": "target", "error_id": "'E' || seg_idx", "materiality": "CASE WHEN conv_id % 12 = 10 THEN 'minor' ELSE 'major' END", "diagnosis": "'lost'", "error_span": "CASE WHEN conv_id % 14 = 11 THEN 'not it' ELSE substring(source, 1, 12) END",
    "repairs": "CASE WHEN conv_id % 15 = 12 THEN 'E' ELSE 'E' || seg_idx END", "decision": "'mended'", "addresses": "'the loss'",
}
_MADE_SQL = f"md AS (SELECT {_CASE} AS case_id, {_CASE} AS segment_id, source, {', '.join(f'{x} AS {name}' for name, x in _MADE.items())}, {_REVISED} AS changed FROM rec)".replace("AS STRING", "AS VARCHAR")


def _eligible(spark, d):
    own = cases.integrity_flags(jobs.records(spark, d))
    return own.withColumn("eligible", F.col("revised") & (F.size("flags") == 0))


_Q = lambda p: p.replace("'", "''")
_FLAT = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'), ' ')"
_PART = lambda k: _FLAT.format(f"regexp_extract(w, '{_Q(REVISION_PAIR)}', {k})")


@query(rf"""{_BASE}, ca AS (SELECT conv_id AS doc_id, seg_idx, {_CASE} AS case_id, initial_target, target, revised AND NOT flagged AS eligible, {_SECTION} AS body FROM r2), sec AS (SELECT doc_id, seg_idx, body FROM ca),
cl AS {at(_Q(REVISION), 80, 120)}, held AS (SELECT * FROM ca WHERE contains(body, case_id) AND (doc_id, seg_idx) IN (SELECT (doc_id, seg_idx) FROM cl)),
said AS (SELECT doc_id, seg_idx, {_PART(1)} AS old, {_PART(2)} AS new FROM cl)
SELECT doc_id, seg_idx, 'invented_revision' AS type, case_id AS ref FROM held WHERE NOT eligible
UNION ALL SELECT doc_id, seg_idx, 'described_revision_not_in_stored_delta', old || '→' || new FROM said JOIN held USING (doc_id, seg_idx)
WHERE old <> '' AND new <> '' AND NOT (eligible AND contains({_FLAT.format("initial_target")}, old) AND contains({_FLAT.format("target")}, new))""")
def described_revisions(spark, d):
    own = _eligible(spark, d).selectExpr("conv_id AS doc_id", "seg_idx", f"{_CASE} AS case_id", "initial_target", "target", "eligible", f"{_SECTION} AS body")
    none = own.limit(0).selectExpr("doc_id", "case_id", "body AS baseline", "body AS optimized")
    return diagnostics.described_revisions(own.select("doc_id", "seg_idx", "body"), own.select("doc_id", "seg_idx", "case_id"), own.select("doc_id", "case_id", "initial_target", "target", "eligible"), none)


def _made(spark, d):
    own = jobs.records(spark, d).selectExpr(f"{_CASE} AS case_id", f"{_CASE} AS segment_id", "source", *[f"{x} AS {name}" for name, x in _MADE.items()])
    return gates.gated(own.drop("source"), own.select("segment_id", "source"))


_GATED = f"""{_BASE}, {_MADE_SQL}, gt AS (SELECT *, list_filter([
CASE WHEN NOT (source_text <> '' AND contains(source, source_text)) THEN 'real_source_exists' END, CASE WHEN NOT (trigger <> '' AND reason <> '' AND contains(lower(source_text), lower(trigger))) THEN 'opportunity_grounded' END, CASE WHEN plausibility <> 'plausible' THEN 'baseline_plausible' END,
CASE WHEN grounding <> 'confirmed' OR NOT contains(lower(source_text), lower(error_span)) OR error_span = '' THEN 'diagnosis_evidence_backed' END, CASE WHEN materiality_check <> 'confirmed' OR materiality = 'minor' THEN 'error_confirmed' END, CASE WHEN correctness <> 'confirmed' THEN 'repair_confirmed' END,
CASE WHEN value IS NULL THEN 'repair_value_confirmed' END, CASE WHEN repairs <> error_id THEN 'repair_traceable' END, CASE WHEN NOT changed THEN 'meaningful_contrast' END, CASE WHEN already_correct THEN 'baseline_not_already_correct' END, CASE WHEN coalesce(unrelated_change, true) THEN 'no_unrelated_meaning_change' END],
lambda x: x IS NOT NULL) AS failed FROM md)"""


@query(f"{_GATED} SELECT case_id, array_to_string(failed, ',') AS failed, failed[1] AS first_failed, len(failed) = 0 AS eligible FROM gt")
def acceptance_gates(spark, d):
    return _made(spark, d).select("case_id", F.array_join("failed", ",").alias("failed"), "first_failed", "eligible")


@query(f"""{_GATED} SELECT count(*) FILTER (coalesce(baseline, '') <> '') AS baselines, count(*) FILTER (coalesce(baseline, '') <> '' AND plausibility <> 'plausible') AS implausible, count(*) FILTER (plausibility = 'plausible' AND list_contains(failed, 'error_confirmed')) AS not_material,
count(*) FILTER (optimized <> '' AND (list_contains(failed, 'repair_confirmed') OR list_contains(failed, 'repair_value_confirmed'))) AS repairs_rejected, count(*) FILTER (len(failed) = 0) AS eligible FROM gt""")
def acceptance_metrics(spark, d):
    return gates.gate_metrics(_made(spark, d))


@query()
def contrast_deltas(spark, d):
    own = jobs.records(spark, d).select("conv_id", "seg_idx", contrast("initial_target", "target").alias("x"))
    return own.select("conv_id", "seg_idx", "x.changed", "x.changes")


# Of each conversation a report: quotes of its pairs, some of them wrong, of another pair, or of none.
_LINES = {
    "SOURCE": f"'> [SOURCE ' || {_CASE} || ']: ' || CASE WHEN seg_idx % 4 = 0 THEN 'changed on the way' ELSE source END", "TARGET": f"'> [TARGET ' || {_CASE} || ']: said > [SOURCE ' || {_CASE} || ']: else'",
    "INITIAL": f"'> [INITIAL ' || {_CASE} || ']: ' || coalesce(initial_target, 'kept as it is')", "SIMULATED": "'> [SIMULATED seg-none]: ' || 'stays'",
}
_QUOTED = ", ".join(_LINES.values())


@query(f"""{_BASE}, li AS (SELECT conv_id, seg_idx, {_CASE} AS case_id, source, target, initial_target, unnest([{_QUOTED}]) AS line, unnest(['SOURCE', 'TARGET', 'INITIAL', 'SIMULATED']) AS kind, unnest([1, 2, 3, 4]) AS k FROM rec),
ex AS (SELECT *, CASE kind WHEN 'SOURCE' THEN source WHEN 'TARGET' THEN target WHEN 'INITIAL' THEN initial_target END AS exact FROM li)
SELECT conv_id, md5(string_agg(CASE WHEN exact IS NULL THEN line ELSE '> [' || kind || ' ' || case_id || ']: ' || exact || CASE WHEN contains(line, chr(10)) THEN substr(line, strpos(line, chr(10))) ELSE '' END END, chr(10) ORDER BY seg_idx, k)) AS body_hash FROM ex GROUP BY conv_id""")
def report_quotes(spark, d):
    own = jobs.records(spark, d).withColumn("case_id", F.expr(_CASE))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.expr(f"array({_QUOTED})").alias("lines")))), lambda x: x["lines"])), "\n")
    reports_ = own.groupBy("conv_id").agg(body.alias("body"))
    saved = own.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in (("SOURCE", "source"), ("TARGET", "target"), ("INITIAL", "initial_target"))])).alias("x")).select("x.kind", "case_id", "x.text")
    return records.exact_quotes(reports_, saved, "conv_id").select("conv_id", F.md5("body").alias("body_hash"))
