"""Queries over what diagnostics, audits and histories come to; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import cases, diagnostics, memory
from glossweave.operators.diagnostics import THEORY
from glossweave.operators.matching import term_matches_in
from glossweave.plans import qualities, studies
from glossweave.plans.catalogue import _CLASSES, _G, _HITS, _PAIRS, _STRIPPED, SQL, _docs, _named, _pairs, _segments, _sentences, query
from glossweave.plans.qualities import _P, _SPOKEN
from glossweave.plans.studies import _BASE, _CLASS
from glossweave.sources import derived, jobs, reports

_PLANNED = reports.PLAN_SQL.replace("plan AS (", "pl AS (", 1)
_FOUND = f"""{_P}, {_PLANNED}, fi AS (
SELECT doc_id, 'research_question_unanswered' AS type, 'research_alignment' AS dimension, 'high' AS severity, 'P1' AS priority, NULL::VARCHAR AS section_id, rq AS claim_id, NULL::VARCHAR AS case_id, 'rewrite' AS repair_action, NULL::VARCHAR AS evidence FROM ({SQL['research_question_matrix']}) WHERE NOT answered
UNION ALL SELECT doc_id, 'orphan_claim', 'research_alignment', 'medium', 'P1', NULL, claim_id, NULL, 'rewrite', NULL FROM documents, (SELECT unnest(['c0', 'c1', 'c2', 'c3', 'c9']) AS claim_id) c WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.doc_id = documents.doc_id AND kind = 'claim' AND ref = claim_id)
UNION ALL SELECT doc_id, 'section_without_research_question', 'research_alignment', 'low', 'P3', 's' || seg_idx, NULL, NULL, 'rewrite', NULL FROM sec WHERE (doc_id, seg_idx) NOT IN (SELECT (doc_id, seg_idx) FROM pl WHERE kind = 'rq')
UNION ALL SELECT doc_id, k, 'case_quality', CASE k WHEN 'weak_case' THEN 'medium' WHEN 'misaligned_case' THEN 'high' ELSE 'critical' END, CASE k WHEN 'weak_case' THEN 'P2' ELSE 'P1' END, NULL, NULL, case_id, 'replace_case', NULL
  FROM (SELECT *, CASE WHEN synthetic AND class = 'weak_case' THEN 'ineligible_synthetic_case_used' WHEN NOT synthetic AND NOT changed THEN 'non_revision_case_used_as_revision_analysis' WHEN class IN ('weak_case', 'misaligned_case') THEN class END AS k
    FROM (SELECT conv_id AS doc_id, 'k' || conv_id || '-' || seg_idx AS case_id, {_CLASS} AS class, changed, conv_id % 5 = 0 AS synthetic FROM ({_BASE} SELECT * FROM sg))) WHERE k IS NOT NULL
UNION ALL SELECT doc_id, 'high_value_evidence_unused', 'evidence_utilization', 'medium', 'P2', NULL, NULL, ref, 'rewrite', NULL FROM ({SQL['evidence_utilization']}) WHERE high_value_unused
UNION ALL SELECT doc_id, 'conclusion_without_trace', 'conclusion_discipline', 'low', 'P3', 's' || seg_idx, NULL, NULL, 'rewrite', sentence FROM ({SQL['conclusion_trace']})
UNION ALL SELECT doc_id, type, 'cross_section_coherence', CASE type WHEN 'duplicate_case_analysis' THEN 'medium' ELSE 'low' END, 'P2', NULL, CASE type WHEN 'duplicate_claim' THEN ref END, CASE type WHEN 'duplicate_case_analysis' THEN ref END, 'rewrite', CASE type WHEN 'duplicate_paragraph' THEN ref END FROM ({SQL['cross_section_repeats']})
UNION ALL SELECT doc_id, type, CASE type WHEN 'case_to_general_rule_overreach' THEN 'conclusion_discipline' ELSE 'analysis_depth' END, CASE type WHEN 'unsupported_process_claim' THEN 'high' ELSE 'medium' END, CASE type WHEN 'unsupported_quality_effect' THEN 'P2' ELSE 'P1' END, 's' || seg_idx, NULL, NULL, 'rewrite', hit FROM ({SQL['unsupported_assertions']})
UNION ALL SELECT doc_id, 'theory_name_dropping', 'theory_case_fit', 'medium', 'P1', 's' || seg_idx, NULL, NULL, 'rewrite', unnest(regexp_extract_all(body, '{THEORY}')) FROM sec)"""


def _dealt(spark, d):
    return derived.dealt_by(derived.table(spark, d, "documents"))


def _diagnosed(spark, d):
    segs, docs, deal = _segments(spark, d), _docs(spark, d), _dealt(spark, d)
    spoken = derived.segments(derived.table(spark, d, "documents").select("doc_id", "text"), last="last").selectExpr("doc_id", "seg_idx", f"{_SPOKEN} AS body", "last")
    plan = reports.plan(segs)
    questions = docs.select("doc_id", F.explode(F.array(*[F.lit(f"q{k}") for k in range(4)])).alias("rq"))
    matrix = diagnostics.question_matrix(plan, questions, reports.registry(spark, qualities._CLAIM_RQ, "claim_id string, rq string"), deal=deal)
    claims = docs.select("doc_id", F.explode(F.array(*map(F.lit, ("c0", "c1", "c2", "c3", "c9")))).alias("claim_id"))
    own = cases.signals(studies._rows(spark, d)).withColumn("class", cases.case_class((F.col("conv_id") + F.col("seg_idx")) % 5 != 0))
    own = own.selectExpr("conv_id AS doc_id", "'k' || conv_id || '-' || seg_idx AS case_id", "class", "conv_id % 5 = 0 AS synthetic", "changed AS revision")
    worth = deal(plan.filter("kind = 'case'").select("doc_id", "ref"), "doc_id", "ref").distinct().selectExpr("doc_id", "ref", "doc_id % 2 = 0 AS severe", "doc_id % 3 = 0 AS changed", "ref LIKE '%3' AS repair", "false AS terms")
    sections = reports.sections(segs)
    return diagnostics.diagnosed(
        matrix, plan, claims, spoken, own, diagnostics.unused_evidence(worth, sections, deal=deal), diagnostics.untraced(spoken, last=F.col("last")), diagnostics.repeats(sections, deal=deal), diagnostics.unsupported(spoken), literature=False, deal=deal
    )


@query(f"{_FOUND} SELECT * FROM fi")
def diagnosed_findings(spark, d):
    return _diagnosed(spark, d).drop("pos")


@query(f"{_FOUND} SELECT type, priority, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM fi GROUP BY ALL")
def diagnosed_counts(spark, d):
    return diagnostics.counted(_diagnosed(spark, d), deal=_dealt(spark, d))


# The audit of a memory: pairs as its rows, with the terms of the glossary that each source holds, in the glossary's order


def _audited(spark, d):
    own = _pairs(spark, d)
    classes = memory.compatibility(own, _named(spark), "conv_id", "seg_idx")
    entries = derived.glossary(spark).filter("status <> 'rejected'").select(F.col("source").alias("term"), F.col("pos").alias("at"))
    met = term_matches_in(own, entries, text_col="source", term_col="term", keep=["conv_id", "seg_idx"])
    matched = met.groupBy("conv_id", "seg_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("matched"))
    rows = classes.join(matched, ["conv_id", "seg_idx"], "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    return rows.withColumn("pos", F.col("conv_id") * 1000 + F.col("seg_idx"))


_AUDIT = f"""WITH {_PAIRS}, {_G}, {_HITS}, {_CLASSES}, ma AS (SELECT conv_id, seg_idx, list(term ORDER BY pos) AS matched FROM (SELECT h.conv_id, h.seg_idx, h.term, g.pos FROM hits h JOIN g USING (id) WHERE h.status <> 'rejected') GROUP BY ALL),
au AS (SELECT n.conv_id, n.seg_idx, class, coalesce(matched, []) AS matched, conv_id * 1000 + seg_idx AS pos FROM named n LEFT JOIN ma USING (conv_id, seg_idx))"""


@query(f"""{_AUDIT} SELECT count(*) AS total, count(*) FILTER (class <> 'unaffected') AS affected, count(*) FILTER (class = 'unaffected') AS unaffected, count(*) FILTER (class = 'compatible') AS compatible, count(*) FILTER (class = 'incompatible') AS incompatible, count(*) FILTER (class = 'ambiguous') AS ambiguous,
count(*) FILTER (class = 'scope_sensitive') AS scope_sensitive, round(count(*) FILTER (class = 'incompatible') / greatest(count(*) FILTER (class <> 'unaffected'), 1), 4) AS incompatible_rate FROM au""")
def tm_audit_statistics(spark, d):
    return memory.audit_statistics(_audited(spark, d))


@query(f"""{_AUDIT}, h AS (SELECT pos, unnest(range(len(matched))) AS k, unnest(matched) AS term FROM au WHERE class = 'incompatible'), t AS (SELECT term, count(*) AS incompatible, min(pos * 1000 + k) AS first FROM h GROUP BY term ORDER BY incompatible DESC, first LIMIT 20)
SELECT term, incompatible, (SELECT count(*) FROM au WHERE contains(array_to_string(matched, ' | '), term)) AS mentioning FROM t""")
def tm_conflicting_terms(spark, d):
    return memory.conflicting_terms(_audited(spark, d))


_CUT = f"(length(source) >= 120 AND length(t) < 0.15 * length(source)) OR ({_sentences('source')} >= 2 AND {_sentences('t')} < 0.5 * {_sentences('source')} AND length(t) < 0.35 * length(source))"


@query(rf"""WITH {_PAIRS}, m AS (SELECT source, CASE WHEN seg_idx % 4 = 0 THEN substring(target, 1, 9) ELSE target END AS target, conv_id % 5 <> 2 AS reviewed FROM pairs), tr AS (SELECT *, {_STRIPPED} AS t FROM m WHERE reviewed AND regexp_matches(source, '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]') AND {_STRIPPED} <> '')
SELECT (SELECT count(*) FROM m) AS raw_entries, count(*) AS trusted, count(*) FILTER ({_CUT}) AS incomplete_in_trusted, count(*) FILTER ({_CUT}) = 0 AS usable FROM tr""")
def tm_health(spark, d):
    own = _pairs(spark, d).selectExpr("source", "CASE WHEN seg_idx % 4 = 0 THEN substring(target, 1, 9) ELSE target END AS target", "conv_id % 5 <> 2 AS reviewed")
    return memory.health(own)


@query(f"""{_BASE} SELECT conv_id, 'issue' AS distribution, type AS category, count(*) AS n FROM fd WHERE NOT resolved GROUP BY ALL UNION ALL SELECT conv_id, 'repair', coalesce(action, 'none'), count(*) FROM fd GROUP BY ALL
UNION ALL SELECT conv_id, 'repair', 'initial_final_changed', count(*) FROM r2 WHERE revised GROUP BY ALL UNION ALL SELECT conv_id, 'coverage', zone, count(*) FROM (SELECT conv_id, CASE WHEN p < 1 / 3 THEN 'beginning' WHEN p < 2 / 3 THEN 'middle' ELSE 'end' END AS zone FROM (SELECT conv_id, seg_idx / greatest(max(seg_idx) OVER (PARTITION BY conv_id), 1) AS p FROM r2)) GROUP BY ALL""")
def project_distributions(spark, d):
    return cases.distributions(cases.integrity_flags(jobs.records(spark, d)), jobs.findings(spark, d))
