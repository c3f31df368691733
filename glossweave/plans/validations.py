"""Queries of the report validator; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import reports as rules
from glossweave.plans.catalogue import _SEG, _docs, _segments, query
from glossweave.sources import reports
from glossweave.sources.reports import KNOWN_SQL, PLAN_SQL, SECTION_SQL, values

_USED = "used AS (SELECT DISTINCT doc_id, seg_idx, kind, ref FROM (" + " UNION ALL ".join(f"SELECT doc_id, seg_idx, '{kind}' AS kind, unnest(regexp_extract_all(body, '{p}', 1)) AS ref FROM sec" for kind, p in rules.MARKERS.items()) + "))"
_BASE = f"WITH {_SEG}, {SECTION_SQL}, {PLAN_SQL}, {KNOWN_SQL}, {_USED}, src AS {values(reports.SOURCES, 'source_id, year, author, citable')}, les AS {values(reports.EVIDENCE_SOURCES, 'evidence_id, source_id')}"
_NAME = "CASE kind WHEN 'rq' THEN 'research_question' WHEN 'lit_claim' THEN 'literature_claim' WHEN 'lit_evidence' THEN 'literature_evidence' ELSE kind END"
_ROW = "SELECT type, severity, doc_id, seg_idx, ref FROM"


def _sections(spark, d):
    return reports.sections(_segments(spark, d))


def _known(spark):
    return reports.registry(spark, reports.KNOWN, "kind string, ref string")


def _sources(spark):
    return reports.registry(spark, reports.SOURCES, "source_id string, year int, author string, citable boolean")


@query(f"""{_BASE}, own AS (SELECT DISTINCT * FROM plan WHERE kind <> 'source'), reg AS (SELECT own.* FROM own SEMI JOIN known USING (kind, ref)), mis AS (SELECT reg.* FROM reg ANTI JOIN used USING (doc_id, seg_idx, kind, ref)),
cu AS (SELECT DISTINCT own.doc_id, own.seg_idx, 1 AS k FROM own SEMI JOIN used USING (doc_id, seg_idx, kind, ref) WHERE kind = 'case'),
ok AS (SELECT doc_id, seg_idx, ref FROM plan WHERE kind = 'source' UNION SELECT doc_id, seg_idx, source_id FROM plan JOIN les ON ref = evidence_id WHERE kind = 'lit_evidence')
SELECT 'outline_unknown_' || {_NAME} AS type, 'error' AS severity, doc_id, seg_idx, ref FROM own ANTI JOIN known USING (kind, ref)
UNION ALL SELECT CASE kind WHEN 'case' THEN 'missing_selected_case' WHEN 'rq' THEN 'missing_research_question_link' ELSE 'missing_planned_' || {_NAME} END, CASE WHEN kind = 'rq' OR (kind = 'case' AND k = 1) THEN 'warning' ELSE 'error' END, doc_id, seg_idx, ref FROM mis LEFT JOIN cu USING (doc_id, seg_idx)
UNION ALL SELECT 'section_' || {_NAME} || '_outside_plan', 'error', doc_id, seg_idx, ref FROM used ANTI JOIN plan USING (doc_id, seg_idx, kind, ref) WHERE kind IN ('lit_claim', 'lit_evidence')
UNION ALL SELECT 'section_literature_outside_plan', 'error', doc_id, seg_idx, ref FROM used ANTI JOIN ok USING (doc_id, seg_idx, ref) WHERE kind = 'source'
UNION ALL SELECT 'outline_source_id_without_grounding', 'error', doc_id, seg_idx, NULL FROM plan GROUP BY doc_id, seg_idx HAVING bool_or(kind = 'source') AND NOT (bool_or(kind = 'lit_claim') AND bool_or(kind = 'lit_evidence'))""")
def outline_violations(spark, d):
    segs = _segments(spark, d)
    evidence_sources = reports.registry(spark, reports.EVIDENCE_SOURCES, "evidence_id string, source_id string")
    return rules.outline_violations(reports.sections(segs), reports.plan(segs), _known(spark), evidence_sources)


_FORMAL = rules.AUTHOR_YEAR.replace("'", "''")


@query(f"""{_BASE}, lost AS (SELECT DISTINCT doc_id, kind, ref FROM used ANTI JOIN known USING (kind, ref)), cited AS (SELECT DISTINCT doc_id, ref, source_id, citable FROM used LEFT JOIN src ON ref = source_id WHERE kind = 'source'),
vis AS (SELECT *, regexp_replace(body, '\\[@[^\\]]+\\]|<!--.*?-->', '', 'gs') AS visible FROM sec), cit AS (SELECT doc_id, seg_idx, visible, ref, year, author FROM vis JOIN used USING (doc_id, seg_idx) JOIN src ON ref = source_id WHERE kind = 'source' AND citable),
y AS (SELECT *, regexp_extract_all(visible, '(?:19|20)\\d{{2}}') AS years FROM cit)
SELECT 'unknown_literature_claim_marker' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, ref FROM lost WHERE kind = 'lit_claim'
UNION ALL SELECT 'unknown_literature_evidence_marker', 'error', doc_id, NULL, ref FROM lost WHERE kind = 'lit_evidence'
UNION ALL SELECT 'unknown_terminology_decision', 'error', doc_id, NULL, ref FROM lost WHERE kind = 'term'
UNION ALL SELECT 'unknown_literature_citation', 'error', doc_id, NULL, ref FROM cited WHERE source_id IS NULL
UNION ALL SELECT 'uncitable_literature_source', 'error', doc_id, NULL, ref FROM cited WHERE NOT citable
UNION ALL SELECT 'citation_metadata_mismatch', 'error', doc_id, seg_idx, ref FROM y WHERE len(years) > 0 AND NOT list_contains(years, year::VARCHAR)
UNION ALL SELECT 'citation_metadata_mismatch', 'error', doc_id, seg_idx, ref FROM cit WHERE regexp_matches(visible, '{_FORMAL}') AND NOT (contains(lower(visible), lower(split_part(author, ' ', 1))) OR contains(lower(visible), lower(split_part(author, ' ', 2))))
UNION ALL SELECT 'unregistered_formal_citation', 'error', doc_id, seg_idx, unnest(regexp_extract_all(body, '{_FORMAL}')) FROM sec WHERE NOT contains(body, '[@')
UNION ALL SELECT DISTINCT 'unresolved_term_token', 'error', doc_id, NULL::INT, NULL FROM sec WHERE contains(body, '{{{{TERM:')""")
def marker_violations(spark, d):
    return rules.marker_violations(_sections(spark, d), _known(spark), _sources(spark))


@query(f"""{_BASE}, hu AS {values(reports.HUMAN, 'human_id, status, conflict')}, ch AS {values(reports.CLAIM_HUMAN, 'claim_id, h')},
u AS (SELECT DISTINCT doc_id, ref, human_id, status, conflict FROM used LEFT JOIN hu ON ref = human_id WHERE kind = 'human'), a AS (SELECT claim_id || ':' || h AS ref, human_id, status FROM ch LEFT JOIN hu ON h = human_id)
SELECT 'unknown_human_evidence' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, ref FROM u WHERE human_id IS NULL
UNION ALL SELECT 'unusable_human_evidence', 'error', doc_id, NULL, ref FROM u WHERE status <> 'user_confirmed'
UNION ALL SELECT 'conflicted_human_evidence', 'error', doc_id, NULL, ref FROM u WHERE status = 'user_confirmed' AND conflict = 'contradicted'
UNION ALL SELECT 'argument_unknown_human_evidence', 'error', NULL, NULL, ref FROM a WHERE human_id IS NULL
UNION ALL SELECT 'argument_unusable_human_evidence', 'error', NULL, NULL, ref FROM a WHERE status <> 'user_confirmed'""")
def human_evidence_violations(spark, d):
    human = reports.registry(spark, reports.HUMAN, "human_id string, status string, conflict string")
    return rules.human_violations(_sections(spark, d), human, reports.registry(spark, reports.CLAIM_HUMAN, "claim_id string, human_id string"))


_ENGLISH = "len(list_filter(regexp_extract_all(line, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)?'), lambda w: regexp_matches(w, '^[A-Za-z]+(?:[''’-][A-Za-z]+)?$')))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x, ' '), '>')), chr(10)), chr(10))) AS line FROM documents)
SELECT DISTINCT 'thesis_body_language_mismatch' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, NULL AS ref FROM l WHERE NOT starts_with(ltrim(line, ' '), '#') AND {_ENGLISH} >= 12 AND {_ENGLISH} > len(regexp_extract_all(line, '[㐀-鿿]'))""")
def language_violations(spark, d):
    return rules.language_violations(_docs(spark, d).select("doc_id", F.col("text").alias("body")))


_CHAPTERS, _SUBSECTIONS = [(0, "Introduction"), (1, "Method"), (2, "Conclusion")], [(1, "1.1", "Scope", 2), (2, "2.1", "Limits", 2)]
_TITLED = "CASE WHEN doc_id % 5 = 0 THEN 'Intro ' || seg_idx ELSE CASE seg_idx WHEN 0 THEN 'Introduction' WHEN 1 THEN ' Method ' ELSE 'Conclusion' END END"
_HEADED = "CASE WHEN seg_idx = 1 AND doc_id % 3 <> 0 THEN '### 1.1 Scope' || chr(10) WHEN seg_idx = 2 AND doc_id % 7 = 0 THEN '### 2.1.Limits' || chr(10) ELSE '' END || text"


@query(f"""WITH {_SEG}, sec AS (SELECT doc_id, seg_idx, {_HEADED} AS body FROM seg), outl AS (SELECT doc_id, k::INT AS seg_idx, {_TITLED.replace('seg_idx', 'k')} AS title, 40 + 20 * k AS least FROM documents, range(4) r(k) WHERE k < 3 OR doc_id % 6 = 0),
ch AS {values(_CHAPTERS, 'seg_idx, title')}, sub AS {values(_SUBSECTIONS, 'seg_idx, heading, title, level')}
SELECT 'empty_report' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, NULL AS ref FROM documents WHERE trim(coalesce(text, ''), ' ') = ''
UNION ALL SELECT 'missing_required_section', 'error', doc_id, seg_idx, NULL FROM outl ANTI JOIN sec USING (doc_id, seg_idx)
UNION ALL SELECT 'section_too_short', 'warning', doc_id, seg_idx, NULL FROM outl JOIN sec USING (doc_id, seg_idx) WHERE length(regexp_replace(body, '\\s+', '', 'g')) < least
UNION ALL SELECT 'institutional_chapter_structure_mismatch', 'error', doc_id, NULL, NULL FROM outl GROUP BY doc_id HAVING list_sort(list(DISTINCT seg_idx)) <> [0, 1, 2]
UNION ALL SELECT 'institutional_chapter_title_mismatch', 'error', doc_id, seg_idx, NULL FROM outl JOIN ch USING (seg_idx) WHERE trim(outl.title, ' ') <> ch.title
UNION ALL SELECT 'missing_institutional_subsection', 'error', doc_id, seg_idx, heading FROM sec JOIN sub USING (seg_idx) WHERE trim(body, ' ') <> '' AND NOT starts_with(body, '###')""")
def structure_violations(spark, d):
    docs, segs = _docs(spark, d), _segments(spark, d)
    outline = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.when(F.col("doc_id") % 6 == 0, 3).otherwise(2))).alias("seg_idx")).selectExpr("doc_id", "seg_idx", f"{_TITLED} AS title", "40 + 20 * seg_idx AS minimum_chars")
    return rules.structure_violations(docs, segs.selectExpr("doc_id", "seg_idx", f"{_HEADED} AS body"), outline, reports.registry(spark, _CHAPTERS, "seg_idx int, title string"), reports.registry(spark, _SUBSECTIONS, "seg_idx int, heading string, title string, level int"))


@query(f"""{_BASE}, l AS (SELECT doc_id, max(seg_idx) AS last FROM sec GROUP BY doc_id), c AS (SELECT doc_id, seg_idx, ref, last FROM used JOIN l USING (doc_id) WHERE kind IN ('case', 'synthetic'))
SELECT 'conclusion_introduces_case_evidence' AS type, 'error' AS severity, doc_id, seg_idx, ref FROM c WHERE seg_idx = last AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.ref = c.ref AND b.seg_idx = c.last - 1)""")
def conclusion_violations(spark, d):
    return rules.conclusion_violations(_sections(spark, d))


_STATUS = "CASE WHEN doc_id % 29 = 5 THEN 'not_applicable' WHEN doc_id % 4 = 0 THEN 'sufficient_revision_cases' WHEN doc_id % 4 = 1 THEN 'two_case_fallback' ELSE 'insufficient_revision_cases' END"
_SAID = "CASE WHEN doc_id % 5 < 2 THEN '<!--case-count-policy:two_case_fallback--> ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '三个 核心案例表明。' WHEN doc_id % 3 = 1 THEN '第三个案例表明。' ELSE '' END || text"


@query(f"""WITH {_SEG}, cs AS (SELECT doc_id, 'case' || seg_idx AS case_id, (doc_id + seg_idx) % 13 <> 7 AS known, (doc_id + seg_idx) % 6 <> 0 AS eligible FROM seg WHERE length(text) >= 180), rp AS (SELECT doc_id, {_STATUS} AS status, {_SAID} AS body FROM documents),
n AS (SELECT rp.doc_id, status, body, count(case_id) AS n FROM rp LEFT JOIN cs USING (doc_id) GROUP BY ALL), e AS (SELECT *, CASE WHEN n >= 3 THEN 'sufficient_revision_cases' WHEN n >= 2 THEN 'two_case_fallback' ELSE 'insufficient_revision_cases' END AS expected FROM n)
SELECT 'case_count_status_mismatch' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, expected AS ref FROM e WHERE expected <> status AND status <> 'not_applicable'
UNION ALL SELECT 'insufficient_core_revision_cases', 'error', doc_id, NULL, NULL FROM e WHERE expected = 'insufficient_revision_cases' AND status <> 'not_applicable'
UNION ALL SELECT 'missing_revision_evidence_scarcity_disclosure', 'error', doc_id, NULL, NULL FROM e WHERE status <> 'not_applicable' AND expected = 'two_case_fallback' AND NOT contains(body, '<!--case-count-policy:two_case_fallback-->')
UNION ALL SELECT 'wrong_core_case_count_claim', 'error', doc_id, NULL, NULL FROM e WHERE status <> 'not_applicable' AND expected = 'two_case_fallback' AND regexp_matches(body, '(?i)(^|[^第])(?:三个|3\\s*个|三则|three)\\s*(?:真实|核心|修订|translation\\s+revision\\s+)*案例')
UNION ALL SELECT 'invalid_selected_case', 'error', doc_id, NULL, case_id FROM cs WHERE NOT known
UNION ALL SELECT 'non_revision_case_used_as_revision_analysis', 'error', doc_id, NULL, case_id FROM cs WHERE known AND NOT eligible""")
def case_policy_violations(spark, d):
    cases = _segments(spark, d).filter(F.length("text") >= 180).select("doc_id", F.concat(F.lit("case"), "seg_idx").alias("case_id"), ((F.col("doc_id") + F.col("seg_idx")) % 13 != 7).alias("known"), ((F.col("doc_id") + F.col("seg_idx")) % 6 != 0).alias("eligible"))
    docs = _docs(spark, d)
    return rules.case_policy_violations(cases, docs.selectExpr("doc_id", f"{_STATUS} AS status"), docs.selectExpr("doc_id", f"{_SAID} AS body"))


_SYNTHETIC = [("SC-0000", True), ("SC-0001", False), ("SC-0002", True)]
_DISCLOSED = "body || CASE WHEN doc_id % 3 = 0 AND seg_idx = 0 THEN ' <!--synthetic-methodology-->' ELSE '' END || CASE WHEN doc_id % 4 = 0 AND seg_idx = 0 THEN ' <!--synthetic-limitation-->' ELSE '' END || CASE WHEN doc_id % 10 = 3 THEN ' a common human translation error' ELSE '' END"


@query(f"""{_BASE}, sd AS (SELECT doc_id, seg_idx, {_DISCLOSED} AS body FROM sec), sel AS (SELECT doc_id, 'SC-000' || (doc_id % 4) AS case_id, doc_id % 8 = 0 AS historical FROM documents WHERE doc_id % 2 = 0), can AS {values(_SYNTHETIC, 'case_id, eligible')},
ch AS (SELECT doc_id, sel.case_id AS ref, historical, coalesce(eligible, false) AS fit FROM sel LEFT JOIN can ON can.case_id = sel.case_id),
w AS (SELECT doc_id, bool_or(contains(body, '<!--synthetic-methodology-->')) AS m, bool_or(contains(body, '<!--synthetic-limitation-->')) AS l, bool_or(regexp_matches(body, '(?i)(?:common|frequent|widespread) human translation error')) AS f FROM sd SEMI JOIN sel USING (doc_id) GROUP BY doc_id)
SELECT DISTINCT 'unknown_synthetic_case' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, ref FROM used WHERE kind = 'synthetic' AND ref NOT IN (SELECT case_id FROM can) AND NOT EXISTS (SELECT 1 FROM sel WHERE sel.doc_id = used.doc_id AND case_id = ref)
UNION ALL SELECT 'ineligible_synthetic_case_selected', 'error', doc_id, NULL, ref FROM ch WHERE NOT fit
UNION ALL SELECT 'synthetic_case_provenance_mismatch', 'error', doc_id, NULL, ref FROM ch WHERE fit AND historical
UNION ALL SELECT 'missing_synthetic_methodology_disclosure', 'error', doc_id, NULL, NULL FROM w WHERE NOT m
UNION ALL SELECT 'missing_synthetic_limitation_disclosure', 'error', doc_id, NULL, NULL FROM w WHERE NOT l
UNION ALL SELECT 'unsupported_human_error_frequency_claim', 'error', doc_id, NULL, NULL FROM w WHERE f""")
def synthetic_violations(spark, d):
    selected = _docs(spark, d).filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("SC-000"), F.col("doc_id") % 4).alias("case_id"), (F.col("doc_id") % 8 == 0).alias("historical"))
    return rules.synthetic_violations(_sections(spark, d).selectExpr("doc_id", "seg_idx", f"{_DISCLOSED} AS body"), selected, reports.registry(spark, _SYNTHETIC, "case_id string, eligible boolean"))


_BARE = "body || CASE WHEN seg_idx % 8 = 1 THEN ' 本项目共 12段' WHEN seg_idx % 8 = 2 THEN ' 本项目共 12段<!--stat:total-->' WHEN seg_idx % 8 = 3 THEN chr(10) || '> 全文 9处' ELSE '' END"


@query(f"""{_BASE}, b AS (SELECT doc_id, seg_idx, {_BARE} AS body FROM sec), l AS (SELECT doc_id, seg_idx, unnest(string_split(body, chr(10))) AS line FROM b)
SELECT DISTINCT 'unresolved_statistic_token' AS type, 'error' AS severity, doc_id, NULL::INT AS seg_idx, unnest(regexp_extract_all(body, '\\{{\\{{STAT:([A-Za-z0-9_.-]+)\\}}\\}}', 1)) AS ref FROM b
UNION ALL SELECT 'unmarked_project_statistic', 'warning', doc_id, seg_idx, NULL FROM l WHERE NOT starts_with(ltrim(line, ' '), '>') AND regexp_matches(line, '本(?:项目|次|文)|全文|段落|审校|复用|术语|发现') AND regexp_matches(line, '\\d+(?:\\.\\d+)?(?:%|段|条|处|次)') AND NOT contains(line, '<!--stat:')""")
def statistic_violations(spark, d):
    return rules.statistic_violations(_sections(spark, d).selectExpr("doc_id", "seg_idx", f"{_BARE} AS body"))


@query(f"""{_BASE}, lost AS (SELECT DISTINCT doc_id, ref FROM used ANTI JOIN known USING (kind, ref) WHERE kind = 'term')
SELECT 'unknown_terminology_decision' AS type, 'error' AS severity, doc_id, (SELECT min(seg_idx) FROM used u WHERE u.doc_id = lost.doc_id AND u.ref = lost.ref) AS seg_idx, ref FROM lost""")
def located_violations(spark, d):
    sections = _sections(spark, d)
    found = rules.marker_violations(sections, _known(spark), _sources(spark)).filter("type = 'unknown_terminology_decision'")
    return rules.first_section_of(found, sections).select("type", "severity", "doc_id", "seg_idx", "ref")
