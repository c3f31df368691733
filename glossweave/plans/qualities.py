"""Queries over a report's quality; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import diagnostics
from glossweave.operators.diagnostics import ANALYSIS, DESCRIPTION, DIMENSION, EFFECT, FILLER, GENERIC, PROCESS, RULE, STRATEGY, SUMMARY, THEORY, TRANSITION
from glossweave.operators.reports import MARKERS
from glossweave.plans.catalogue import _SEG, _docs, _segments, query
from glossweave.plans.validations import _BASE
from glossweave.sources import reports
from glossweave.sources.reports import values

#: Paragraphs of all kinds: a segment's text after a phrase that its number picks.
_PHRASES = ["", "这说明 ", "综上所述，笔者认为 ", "首先 ", "skopos: this suggests ", "译文将 ", "本节小结 ", "in conclusion, the translator believes ", "本文将对 ", "the author initially considered it. ", "采用了直译策略，提高了译文的可读性；运用了增译策略，使译文更加自然 ", "improves readability; hence literary translation should "]
_SPOKEN = "CASE seg_idx % 12 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PHRASES)) + " END || CASE WHEN doc_id % 2 = 0 THEN text ELSE substring(text, 1, 20) || chr(10) || chr(10) || substring(text, 21) END || CASE WHEN (doc_id + seg_idx) % 7 = 0 THEN ' <!--claim:c1-->' WHEN (doc_id + seg_idx) % 7 = 1 THEN ' [@src1]' WHEN (doc_id + seg_idx) % 7 = 2 THEN ' seg-j-0001' ELSE '' END"
_P = rf"WITH {_SEG}, sec AS (SELECT doc_id, seg_idx, {_SPOKEN} AS body FROM seg), p AS (SELECT doc_id, seg_idx, trim(x, ' ') AS x FROM (SELECT doc_id, seg_idx, unnest(string_split_regex(body, '\n\s*\n')) AS x FROM sec) WHERE trim(x, ' ') <> '')"
_IS = lambda x, p: f"regexp_matches({x}, '{p}')"
_ROLE = f"""CASE WHEN {_IS('x', '|'.join(MARKERS[k] for k in ('claim', 'rq', 'lit_claim')))} THEN 'claim' WHEN {_IS('x', MARKERS['case'] + '|' + MARKERS['lit_evidence'])} THEN 'evidence' WHEN {_IS('x', '|'.join(GENERIC.values()))} THEN 'generic' WHEN {_IS('x', SUMMARY)} THEN 'summary'
WHEN {_IS('x', TRANSITION)} THEN 'transition' WHEN {_IS('x', THEORY)} AND {_IS('x', ANALYSIS)} THEN 'theoretical_interpretation' WHEN {_IS('x', DESCRIPTION)} THEN 'translation_description' WHEN {_IS('x', ANALYSIS)} THEN 'analysis' WHEN length(x) < 40 OR {_IS('x', FILLER)} THEN 'filler' ELSE 'background' END"""


def _spoken(spark, d):
    return _segments(spark, d).selectExpr("doc_id", "seg_idx", f"{_SPOKEN} AS body")


@query(f"{_P}, r AS (SELECT doc_id, {_ROLE} AS role FROM p), n AS (SELECT doc_id, role, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT NULL, role, count(*) FROM r GROUP BY role) SELECT doc_id, role, n, round(n / sum(n) OVER (PARTITION BY doc_id), 3) AS share FROM n")
def paragraph_role_shares(spark, d):
    return diagnostics.role_counts(_spoken(spark, d))


@query(f"{_P} SELECT name AS pattern, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest([{', '.join(f'CASE WHEN {_IS(chr(120), v)} THEN {chr(39)}{k}{chr(39)} END' for k, v in GENERIC.items())}]) AS name FROM p) WHERE name IS NOT NULL GROUP BY name")
def generic_pattern_counts(spark, d):
    each = diagnostics.paragraphs(_spoken(spark, d)).select("doc_id", F.explode(diagnostics.generic_patterns(F.col("paragraph"))).alias("pattern"))
    return each.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def at(p: str, before: int, after: int) -> str:
    """Matches and their windows in bodies of ``sec``, by trying every place: a pattern that a place begins, and the text around it."""
    return f"""(SELECT doc_id, seg_idx, m, body, substr(body, (greatest(i - 1 - {before}, 0) + 1)::BIGINT, (i - 1 + length(m) + {after} - greatest(i - 1 - {before}, 0))::BIGINT) AS w
  FROM (SELECT doc_id, seg_idx, body, i, regexp_extract(substr(body, i), '^(?:{p})') AS m FROM (SELECT *, unnest(range(1, length(body) + 1)) AS i FROM sec WHERE {_IS('body', p)})) WHERE m <> '')"""


@query(rf"""{_P}, h AS (SELECT doc_id, seg_idx, 'strategy_label_without_mechanism' AS type, m || ' ' || w AS hit FROM {at(STRATEGY, 40, 80)} WHERE {_IS('w', EFFECT)}
UNION ALL SELECT doc_id, seg_idx, 'unsupported_quality_effect', w FROM {at(EFFECT, 60, 60)} WHERE NOT {_IS('w', DIMENSION)}
UNION ALL SELECT doc_id, seg_idx, 'unsupported_process_claim', w FROM {at(PROCESS, 40, 120)} WHERE NOT (contains(w, '<!--') AND contains(w, 'finding'))
UNION ALL SELECT doc_id, seg_idx, 'case_to_general_rule_overreach', w FROM {at(RULE, 50, 60)}) SELECT doc_id, seg_idx, type, substring(trim(regexp_replace(hit, '\s+', ' ', 'g'), ' '), 1, 160) AS hit FROM h""")
def unsupported_assertions(spark, d):
    return diagnostics.unsupported(_spoken(spark, d))


_CLAIM_RQ = [("c0", "q0"), ("c1", "q0"), ("c2", "q1"), ("c3", "q7")]


@query(f"""{_BASE}, cr AS {values(_CLAIM_RQ, 'claim_id, rq')}, qs AS (SELECT doc_id, 'q' || k AS rq FROM documents, range(4) t(k)),
pc AS (SELECT doc_id, rq, count(*) AS n FROM (SELECT DISTINCT doc_id, ref FROM plan WHERE kind = 'claim') JOIN cr ON ref = claim_id GROUP BY ALL), ps AS (SELECT doc_id, ref AS rq, count(DISTINCT seg_idx) AS n FROM plan WHERE kind = 'rq' GROUP BY ALL)
SELECT doc_id, rq, coalesce(pc.n, 0) AS n_claims, coalesce(ps.n, 0) AS n_sections, coalesce(pc.n, 0) > 0 AND coalesce(ps.n, 0) > 0 AS answered, CASE WHEN coalesce(pc.n, 0) = 0 THEN 'no_claim' WHEN coalesce(ps.n, 0) = 0 THEN 'no_section' END AS reason FROM qs LEFT JOIN pc USING (doc_id, rq) LEFT JOIN ps USING (doc_id, rq)""")
def research_question_matrix(spark, d):
    questions = _docs(spark, d).select("doc_id", F.explode(F.array(*[F.lit(f"q{k}") for k in range(4)])).alias("rq"))
    return diagnostics.question_matrix(reports.plan(_segments(spark, d)), questions, reports.registry(spark, _CLAIM_RQ, "claim_id string, rq string"))


@query(rf"""{_BASE}, pp AS (SELECT doc_id, seg_idx, unnest(string_split_regex(body, '\n\s*\n')) AS x FROM sec), h AS (SELECT doc_id, seg_idx, sha256(substring(trim(regexp_replace(x, '\s+', ' ', 'g'), ' '), 1, 400)) AS ref FROM pp WHERE trim(x, ' ') <> '')
SELECT doc_id, 'duplicate_paragraph' AS type, ref, count(DISTINCT seg_idx) AS n FROM h GROUP BY doc_id, ref HAVING count(DISTINCT seg_idx) > 1
UNION ALL SELECT doc_id, CASE kind WHEN 'claim' THEN 'duplicate_claim' ELSE 'duplicate_case_analysis' END, ref, count(DISTINCT seg_idx) FROM used WHERE kind IN ('case', 'synthetic', 'claim') GROUP BY doc_id, kind, ref HAVING count(DISTINCT seg_idx) > 1""")
def cross_section_repeats(spark, d):
    return diagnostics.repeats(reports.sections(_segments(spark, d))).select("doc_id", "type", "ref", "n")


_TRACED = "|".join(MARKERS[k] for k in ("claim", "rq", "case", "source", "lit_claim"))


@query(rf"""{_P}, l AS (SELECT doc_id, max(seg_idx) AS seg_idx FROM sec GROUP BY doc_id), o AS (SELECT p.* FROM p JOIN l USING (doc_id, seg_idx) WHERE NOT regexp_matches(x, '{_TRACED}') AND NOT regexp_matches(x, '^\s*#{{1,6}}\s+')),
s AS (SELECT doc_id, seg_idx, trim(regexp_replace(unnest(string_split(regexp_replace(regexp_replace(x, '<!--.*?-->', '', 'gs'), '([。！？；!?;])\s*', '\1' || chr(1), 'g'), chr(1))), '\s+', ' ', 'g'), ' ') AS sentence FROM o)
SELECT doc_id, seg_idx, substring(sentence, 1, 160) AS sentence FROM s WHERE length(sentence) >= 12""")
def conclusion_trace(spark, d):
    return diagnostics.untraced(_spoken(spark, d))


@query(f"""{_BASE}, cs AS (SELECT DISTINCT doc_id, ref FROM plan WHERE kind = 'case'), f AS (SELECT cs.*, doc_id % 2 = 0 AS severe, doc_id % 3 = 0 AS changed, ref LIKE '%3' AS repair, false AS terms, EXISTS (SELECT 1 FROM used u WHERE u.doc_id = cs.doc_id AND u.ref = cs.ref AND kind = 'case') AS used FROM cs)
SELECT doc_id, ref, used, CASE WHEN used THEN '' ELSE array_to_string(list_filter([CASE WHEN severe THEN 'severe' END, CASE WHEN changed THEN 'changed' END, CASE WHEN repair THEN 'repair' END], lambda x: x IS NOT NULL), ',') END AS unused, NOT used AND (severe OR changed OR repair) AS high_value_unused FROM f""")
def evidence_utilization(spark, d):
    segs = _segments(spark, d)
    own = reports.plan(segs).filter("kind = 'case'").select("doc_id", "ref").distinct()
    own = own.select("doc_id", "ref", (F.col("doc_id") % 2 == 0).alias("severe"), (F.col("doc_id") % 3 == 0).alias("changed"), F.col("ref").endswith("3").alias("repair"), F.lit(False).alias("terms"))
    return diagnostics.unused_evidence(own, reports.sections(segs)).select("doc_id", "ref", "used", F.array_join("unused", ",").alias("unused"), "high_value_unused")


# A model's findings, derived from segments, with values that need mending

_FINDING = {
    "dimension": "CASE doc_id % 4 WHEN 0 THEN 'case_quality' WHEN 1 THEN 'analysis_depth' WHEN 2 THEN 'redundancy' ELSE 'unheard_of' END", "severity": "CASE seg_idx % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'dire' END",
    "priority": "CASE (doc_id + seg_idx) % 5 WHEN 0 THEN 'p0' WHEN 1 THEN 'P1' WHEN 2 THEN 'P3' WHEN 3 THEN 'P9' END", "reason": "CASE WHEN (doc_id + seg_idx) % 6 = 0 THEN ' ' ELSE 'because' END",
    "repair_action": "CASE seg_idx % 3 WHEN 0 THEN 'replace_case' WHEN 1 THEN 'narrow' ELSE 'explode' END", "section_id": "'s' || (seg_idx % 4)", "claim_id": "'c' || (seg_idx % 5)", "case_id": "'k' || (doc_id % 3)", "pos": "seg_idx",
}
_RAW = ", ".join(f"{x} AS {name}" for name, x in _FINDING.items())
_IDS = [("section", f"s{k}") for k in range(3)] + [("claim", f"c{k}") for k in range(3)] + [("case", "k0"), ("case", "k1")]
_MENDED = f"""WITH {_SEG}, raw AS (SELECT doc_id, {_RAW} FROM seg), ids AS {values(_IDS, 'kind, ref')}, m AS (SELECT doc_id, pos, dimension, CASE WHEN lower(coalesce(severity, 'medium')) IN ('critical', 'high', 'medium', 'low') THEN lower(coalesce(severity, 'medium')) ELSE 'medium' END AS severity,
CASE WHEN upper(coalesce(priority, 'P2')) IN ('P0', 'P1', 'P2', 'P3') THEN upper(coalesce(priority, 'P2')) ELSE 'P2' END AS priority, CASE WHEN repair_action = 'replace_case' AND case_id IN (SELECT ref FROM ids WHERE kind = 'case') THEN 'replace_case' WHEN repair_action = 'narrow' THEN 'narrow' ELSE 'rewrite' END AS repair_action,
CASE WHEN section_id IN (SELECT ref FROM ids WHERE kind = 'section') THEN section_id END AS section_id, CASE WHEN claim_id IN (SELECT ref FROM ids WHERE kind = 'claim') THEN claim_id END AS claim_id, CASE WHEN case_id IN (SELECT ref FROM ids WHERE kind = 'case') THEN case_id END AS case_id
FROM raw WHERE dimension <> 'unheard_of' AND trim(reason, ' ') <> ''),
o AS (SELECT *, printf('AQ-%03d', row_number() OVER (PARTITION BY doc_id ORDER BY priority, list_position(['critical', 'high', 'medium', 'low'], severity), coalesce(section_id, ''), coalesce(case_id, ''), pos)) AS issue_id FROM m)"""


def _mended(spark, d):
    raw = _segments(spark, d).selectExpr("doc_id", *[f"{x} AS {name}" for name, x in _FINDING.items()])
    known = reports.registry(spark, _IDS, "kind string, ref string")
    mended = diagnostics.normalized(raw, known, dimensions=("case_quality", "analysis_depth", "redundancy"), actions=("rewrite", "replace_case", "narrow", "remove"))
    return diagnostics.prioritized(mended)


@query(f"{_MENDED} SELECT doc_id, issue_id, dimension, severity, priority, repair_action, section_id, claim_id, case_id FROM o")
def quality_findings(spark, d):
    return _mended(spark, d).select("doc_id", "issue_id", "dimension", "severity", "priority", "repair_action", "section_id", "claim_id", "case_id")


@query(f"{_MENDED} SELECT priority, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM o GROUP BY ALL")
def quality_finding_counts(spark, d):
    return _mended(spark, d).groupBy("priority", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""{_MENDED}, u AS (SELECT doc_id, issue_id, CASE WHEN repair_action = 'replace_case' THEN 'case:' || case_id WHEN section_id IS NOT NULL THEN 'section:' || section_id END AS unit, repair_action FROM o WHERE priority <> 'P3') SELECT * FROM u WHERE unit IS NOT NULL""")
def quality_repair_plan(spark, d):
    return diagnostics.repair_plan(_mended(spark, d)).select("doc_id", "issue_id", "unit", "repair_action")


@query(f"""{_BASE}, m AS (SELECT 'seg-j-000' || k AS old_id, 'seg-j-000' || (k + 1) AS new_id FROM range(0, 6, 2) t(k)) SELECT doc_id, seg_idx, coalesce(new_id, ref) AS case_id FROM plan LEFT JOIN m ON ref = old_id WHERE kind = 'case'""")
def case_substitution(spark, d):
    edges = reports.plan(_segments(spark, d)).filter("kind = 'case'").select("doc_id", "seg_idx", F.col("ref").alias("case_id"))
    mapping = spark.range(0, 6, 2).select(F.concat(F.lit("seg-j-000"), "id").alias("old_id"), F.concat(F.lit("seg-j-000"), F.col("id") + 1).alias("new_id"))
    return diagnostics.replaced(edges, mapping)
