"""Queries over literature and human evidence; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import cases, human, literature
from glossweave.operators.numbering import numbered
from glossweave.plans.catalogue import _SEG, _docs, _segments, query
from glossweave.plans.studies import _BASE, _rows

# A registry of the documents' first words: titles, authors and states by number

_REGISTRY = {
    "source_id": "CASE WHEN doc_id % 50 = 49 THEN ' ' ELSE 'ref-' || (doc_id % 600) END", "title": "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END", "authors": "CASE doc_id % 4 WHEN 0 THEN 'Ann Lee; Bo Ek' WHEN 1 THEN 'Ann Lee；' WHEN 2 THEN ' ; ' END",
    "year": "CASE WHEN doc_id % 7 <> 0 THEN 1990 + doc_id % 30 END", "status": "CASE doc_id % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'user_provided' WHEN 2 THEN 'rejected' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'imported_notes' END",
    "content_availability": "CASE WHEN doc_id % 9 = 0 THEN 'notes_only' WHEN doc_id % 9 = 1 THEN 'unknown' END", "allowed": "CASE WHEN doc_id % 13 = 0 THEN false END", "has_content": "doc_id % 3 = 0", "n_excerpts": "doc_id % 2", "n_notes": "doc_id % 5", "pos": "doc_id",
}
_REG = ", ".join(f"{x} AS {name}" for name, x in _REGISTRY.items())


def _registry(spark, d):
    return _docs(spark, d).selectExpr(*[f"{x} AS {name}" for name, x in _REGISTRY.items()])


@query(f"""WITH r AS (SELECT {_REG} FROM documents), o AS (SELECT * REPLACE (trim(source_id, ' ') AS source_id) FROM r WHERE trim(source_id, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY trim(source_id, ' ') ORDER BY pos) = 1),
s AS (SELECT *, CASE WHEN status IN ('verified') THEN 'metadata_verified' WHEN status = 'imported_notes' THEN 'imported_unverified' WHEN status IN ('user_provided', 'rejected') THEN status ELSE 'candidate' END AS st, list_filter(list_transform(string_split_regex(coalesce(authors, ''), '[;；]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS au FROM o)
SELECT source_id, array_to_string(au, '|') AS authors, st AS status, CASE WHEN content_availability = 'notes_only' THEN 'notes_only' WHEN has_content THEN 'full_text_available' WHEN n_excerpts > 0 THEN 'partial_text_available' WHEN n_notes > 0 THEN 'notes_only' ELSE 'metadata_only' END AS content_availability,
coalesce(allowed, st IN ('metadata_verified', 'user_provided')) AND st IN ('metadata_verified', 'user_provided') AND trim(title, ' ') <> '' AND len(au) > 0 AND year IS NOT NULL AS citation_allowed FROM s""")
def literature_registry(spark, d):
    return literature.registry(_registry(spark, d)).select("source_id", F.array_join("authors", "|").alias("authors"), "status", "content_availability", "citation_allowed")


# Names that are alike, some with a number of their own at the end, some with two, and whole texts.
_NAME = "CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source || ' ' || (1 + doc_id % 5) WHEN 2 THEN source || '-2-' || (doc_id % 3 + 1) ELSE text END"


@query(rf"""WITH s AS (SELECT doc_id, coalesce(nullif(lower(regexp_replace(regexp_replace({_NAME}, '[^A-Za-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')), ''), 'reference') AS s FROM documents),
f AS (SELECT list(doc_id ORDER BY doc_id) AS ids, list(s ORDER BY doc_id) AS names FROM s GROUP BY regexp_replace(s, '(?:-[0-9]+)+$', '')),
g AS (SELECT ids, list_reduce(list_transform(names, lambda n: [n]), lambda u, x: list_append(u, CASE WHEN NOT list_contains(u, x[1]) THEN x[1] ELSE x[1] || '-' || list_filter(range(2, len(u) + 3), lambda k: NOT list_contains(u, x[1] || '-' || k))[1] END), []::VARCHAR[]) AS given FROM f)
SELECT doc_id, md5(unique_id) AS unique_id FROM (SELECT unnest(ids) AS doc_id, unnest(given) AS unique_id FROM g)""")
def unique_source_ids(spark, d):
    rows = _docs(spark, d).selectExpr("doc_id", f"{_NAME} AS name")
    return literature.unique_ids(rows, "name", "doc_id").select("doc_id", F.md5("unique_id").alias("unique_id"))


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'excerpt' WHEN 2 THEN 'passage' ELSE 'content' END"
_PARTED = "CASE WHEN doc_id % 40 = 7 THEN ' ' ELSE replace(text, chr(10), chr(10) || chr(10)) END"
_BLOCKS = rf"""so AS (SELECT 'ref-' || (doc_id % 300) AS source_id, {_KIND} AS kind, {_PARTED} AS text, doc_id AS pos FROM documents),
pa AS (SELECT source_id, kind, list_position(['content', 'note', 'excerpt', 'passage'], kind) AS rank, pos, unnest(range(len(x))) AS paragraph, unnest(x) AS whole FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS x FROM so)),
cu AS (SELECT source_id, kind, rank, pos, paragraph, unnest(range(0, length(whole), 1200)) AS piece, substring(whole, (unnest(range(0, length(whole), 1200)) + 1)::INT, 1200) AS text FROM pa),
b1 AS (SELECT *, substring(sha256(concat_ws('|', source_id, kind, text)), 1, 16) AS block_id FROM cu), b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY source_id, block_id ORDER BY rank, pos, paragraph, piece) = 1),
bl AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank, pos, paragraph, piece) AS n FROM b2 QUALIFY n <= 80),
ev AS (SELECT 'LE-' || substring(sha256(concat_ws('|', source_id, coalesce(block_id, 'metadata_only'))), 1, 16) AS evidence_id, source_id, coalesce(text, '') AS text, CASE kind WHEN 'content' THEN 'source_text_verified' WHEN 'note' THEN 'user_note' WHEN 'excerpt' THEN 'manual_excerpt' WHEN 'passage' THEN 'model_extracted_from_source' ELSE 'metadata_only' END AS provenance,
CASE kind WHEN 'note' THEN 'note' WHEN 'excerpt' THEN 'excerpt' WHEN 'content' THEN 'source_passage' WHEN 'passage' THEN 'source_passage' ELSE 'metadata_only' END AS evidence_type FROM (SELECT DISTINCT source_id FROM so) LEFT JOIN bl USING (source_id))"""


def _evidence(spark, d):
    sources = _docs(spark, d).selectExpr("'ref-' || (doc_id % 300) AS source_id", f"{_KIND} AS kind", f"{_PARTED} AS text", "doc_id AS pos")
    return sources, literature.evidence(sources, literature.blocks(sources))


@query(f"WITH {_BLOCKS} SELECT evidence_id, source_id, md5(text) AS text_hash, provenance, evidence_type, text <> '' AS eligible FROM ev")
def literature_evidence(spark, d):
    return _evidence(spark, d)[1].select("evidence_id", "source_id", F.md5("text").alias("text_hash"), "provenance", "evidence_type", "eligible")


@query(f"""WITH {_BLOCKS} SELECT source_id, count(*) FILTER (WHERE text <> '') AS n_evidence, CASE WHEN bool_or(provenance = 'source_text_verified') THEN 'full_text_available' WHEN bool_or(provenance IN ('manual_excerpt', 'model_extracted_from_source')) THEN 'partial_text_available' WHEN bool_or(provenance = 'user_note') THEN 'notes_only' ELSE 'metadata_only' END AS availability FROM ev GROUP BY source_id""")
def literature_availability(spark, d):
    return literature.availability(_evidence(spark, d)[1])


@query(f"""WITH {_BLOCKS}, cl AS (SELECT 'lc' || CAST(substring(source_id, 5) AS INT) AS claim_id, source_id, CASE WHEN CAST(substring(source_id, 5) AS INT) % 9 = 0 THEN ' ' ELSE 'says' END AS statement, min(evidence_id) AS own, max(evidence_id) AS other FROM ev GROUP BY source_id),
sh AS (SELECT *, lag(own, 1, 'LE-none') OVER (ORDER BY source_id) AS strange FROM cl), ci AS (SELECT claim_id, source_id AS of, unnest([own, other, strange, own]) AS evidence_id FROM sh),
k AS (SELECT claim_id, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS supported_by, bool_and(provenance = 'source_text_verified') AS t, bool_or(provenance = 'model_extracted_from_source') AS m FROM ci JOIN ev USING (evidence_id) WHERE of = source_id AND text <> '' GROUP BY claim_id)
SELECT claim_id, source_id, CASE WHEN trim(statement, ' ') <> '' THEN supported_by END AS supported_by, CASE WHEN trim(statement, ' ') = '' OR supported_by IS NULL THEN 'rejected' WHEN t THEN 'grounded' WHEN m THEN 'needs_review' ELSE 'grounded_user_material' END AS status FROM sh LEFT JOIN k USING (claim_id)""")
def literature_claims(spark, d):
    sources, found = _evidence(spark, d)
    k = F.substring("source_id", 5, 9).cast("int")
    ends = found.groupBy("source_id").agg(F.min("evidence_id").alias("own"), F.max("evidence_id").alias("other"))
    placed = numbered(ends, "source_id", name="at")
    before = placed.select((F.col("at") + 1).alias("at"), F.col("own").alias("strange"))
    ends = placed.join(before, "at", "left").withColumn("strange", F.coalesce("strange", F.lit("LE-none"))).drop("at")
    claims = ends.select(F.concat(F.lit("lc"), k).alias("claim_id"), "source_id", F.when(k % 9 == 0, " ").otherwise("says").alias("statement"), F.array("own", "other", "strange", "own").alias("evidence_ids"))
    return literature.ground(claims, found, sources).withColumn("supported_by", F.array_join(F.array_sort("supported_by"), ","))


_PLAN = {"project": "['seg-' || doc_id, 'seg-' || (doc_id * 2)]", "literature_claims": "['lc' || (doc_id % 5), 'lc' || (doc_id % 9)]", "literature_evidence": "['e' || (doc_id % 7), 'e' || (doc_id % 3)]"}


@query(f"""WITH c AS (SELECT 'c' || doc_id AS claim_id, doc_id, {", ".join(f"{x} AS {n}" for n, x in _PLAN.items())} FROM documents), lc AS (SELECT 'lc' || k AS literature_claim_id, ['e' || k, 'e' || (k + 1)] AS evidence_ids FROM range(5) t(k)),
a AS (SELECT claim_id, list_sort(list(DISTINCT ref)) AS project FROM (SELECT claim_id, unnest(project) AS ref FROM c) WHERE ref IN (SELECT 'seg-' || doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY claim_id),
b AS (SELECT claim_id, list_sort(list(DISTINCT literature_claim_id)) AS lcs, flatten(list(evidence_ids)) AS rests FROM (SELECT claim_id, unnest(literature_claims) AS literature_claim_id FROM c) JOIN lc USING (literature_claim_id) GROUP BY claim_id),
f AS (SELECT claim_id, coalesce(a.project, []) AS p, coalesce(lcs, []) AS l, list_sort(list_distinct(list_filter(literature_evidence, lambda x: list_contains(coalesce(rests, []), x)))) AS e FROM c LEFT JOIN a USING (claim_id) LEFT JOIN b USING (claim_id))
SELECT claim_id, array_to_string(p, ',') AS project, array_to_string(l, ',') AS literature_claims, array_to_string(e, ',') AS literature_evidence, CASE WHEN len(p) > 0 AND len(l) > 0 AND len(e) > 0 THEN 'mixed' WHEN len(l) > 0 AND len(e) > 0 THEN 'literature' WHEN len(p) > 0 THEN 'project' ELSE 'author' END AS support FROM f""")
def argument_grounding(spark, d):
    docs = _docs(spark, d)
    claims = docs.selectExpr("'c' || doc_id AS claim_id", *[f"array({x.strip('[]')}) AS {n}" for n, x in _PLAN.items()])
    known = spark.range(5).selectExpr("'lc' || id AS literature_claim_id", "array('e' || id, 'e' || (id + 1)) AS evidence_ids")
    found = literature.plan_grounding(claims, known, docs.filter("doc_id % 3 = 0").selectExpr("'seg-' || doc_id AS segment_id"))
    return found.select("claim_id", *[F.array_join(c, ",").alias(c) for c in ("project", "literature_claims", "literature_evidence")], "support")


# Human evidence: gaps of the derived cases

_DIMENSIONS = ("problem_definition", "evidence_use", "initial_failure_or_alternative", "decision_rationale", "translation_effect", "theory_mapping", "bounded_conclusion")
_GAP = "(conv_id + seg_idx + k) % 3 <> 0"
_GAPS = f"""ga AS (SELECT conv_id * 1000 + seg_idx AS case_id, dimension, conv_id % 5 = 0 AS synthetic, initial_target IS NOT NULL AS available, changed, n_findings > 0 AS has_findings, conv_id % 3 = 0 AS urgent FROM sg, (SELECT unnest({list(_DIMENSIONS)}) AS dimension, unnest(range({len(_DIMENSIONS)})) AS k) WHERE {_GAP}),
ne AS (SELECT *, CASE WHEN synthetic AND dimension = 'initial_failure_or_alternative' THEN 'synthetic_baseline_plausibility' WHEN synthetic AND dimension IN ('decision_rationale', 'translation_effect', 'bounded_conclusion') THEN 'synthetic_optimization_preference' WHEN dimension = 'decision_rationale' THEN 'repair_reason'
WHEN dimension = 'translation_effect' THEN 'reader_response' WHEN dimension = 'initial_failure_or_alternative' THEN 'alternative_considered' WHEN dimension = 'theory_mapping' THEN 'theoretical_intention' WHEN dimension = 'evidence_use' THEN 'reviewer_feedback' WHEN dimension = 'bounded_conclusion' THEN 'translator_rationale' ELSE 'other_author_context' END AS need FROM ga WHERE changed),
on1 AS (SELECT * FROM ne WHERE need NOT IN ('reviewer_feedback', 'other_author_context') QUALIFY row_number() OVER (PARTITION BY case_id, need ORDER BY dimension) = 1),
va AS (SELECT *, CASE WHEN urgent AND dimension IN ('decision_rationale', 'evidence_use') THEN 'critical' WHEN need IN ('translator_rationale', 'repair_reason', 'reader_response', 'alternative_considered', 'synthetic_baseline_plausibility', 'synthetic_optimization_preference') THEN CASE WHEN dimension IN ('decision_rationale', 'translation_effect', 'bounded_conclusion') THEN 'high' ELSE 'medium' END ELSE 'low' END AS value FROM on1)"""


@query(f"{_BASE}, {_GAPS} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY list_position(['critical', 'high', 'medium', 'low'], value), dimension)::INT AS n, need, dimension, value FROM va QUALIFY n <= 2")
def evidence_needs(spark, d):
    own = cases.signals(_rows(spark, d)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(_DIMENSIONS) - 1)))).filter(_GAP)
    gaps = own.select(
        (F.col("conv_id") * 1000 + F.col("seg_idx")).alias("case_id"), F.element_at(F.array(*map(F.lit, _DIMENSIONS)), F.col("k") + 1).alias("dimension"), (F.col("conv_id") % 5 == 0).alias("synthetic"), F.col("initial_target").isNotNull().alias("available"),
        "changed", F.col("initial_target").isNotNull().alias("has_initial"), (F.col("n_findings") > 0).alias("has_findings"), (F.col("conv_id") % 3 == 0).alias("urgent"),
    )
    return human.needs(gaps)


_ANSWER = """CASE seg_idx % 6 WHEN 0 THEN 'not sure.' WHEN 1 THEN ' ' WHEN 2 THEN 'I wrote "' || substring(text, 1, 12) || '" there' WHEN 3 THEN 'I wrote "never written" there' WHEN 4 THEN 'I wrote "' || substring(text, 15, 10) || '" there' ELSE 'no quote' END"""
_ASKED = "CASE (doc_id + seg_idx) % 3 WHEN 0 THEN 'repair_reason' WHEN 1 THEN 'reader_response' ELSE 'initial_translation_missing' END"
_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'), ' ')"


@query(rf"""WITH {_SEG}, a AS (SELECT doc_id, seg_idx, {_ASKED} AS question, {_ANSWER} AS answer, CASE WHEN doc_id % 4 <> 0 THEN substring(text, 1, 14) ELSE '' END AS initial, text AS final FROM seg),
q AS (SELECT *, {_FLAT.format("initial")} AS i, {_FLAT.format("final")} AS f, list_transform(regexp_extract_all(answer, '[“"''『「]([^”"''』」]{{2,80}})[”"''』」]', 1), lambda x: {_FLAT.format("x")}) AS quoted FROM a),
s AS (SELECT *, list_filter(quoted, lambda x: x <> '' AND NOT contains(i, x)) AS strange FROM q)
SELECT doc_id, seg_idx, question, CASE WHEN trim(answer, ' ') = '' THEN 'needs_clarification' WHEN answer = 'not sure.' THEN 'unavailable_after_human_check' ELSE 'user_confirmed' END AS status,
CASE WHEN i = '' OR len(quoted) = 0 THEN 'not_corroborated' WHEN question <> 'reader_response' AND len(strange) > 0 THEN CASE WHEN contains(f, strange[1]) THEN 'not_corroborated' ELSE 'contradicted' END ELSE 'consistent' END AS conflict FROM s""".replace("answer = 'not sure.'", "regexp_matches(trim(answer, ' '), '(?i)^not sure[。！？!?.]?$') AND false"))
def human_answers(spark, d):
    own = _segments(spark, d).selectExpr("doc_id", "seg_idx", f"{_ASKED} AS question", f"{_ANSWER} AS answer", "CASE WHEN doc_id % 4 <> 0 THEN substring(text, 1, 14) ELSE '' END AS initial", "text AS final")
    return own.select("doc_id", "seg_idx", "question", human.answer_status(F.col("answer")).alias("status"), human.conflict(F.col("question"), F.col("answer"), F.col("initial"), F.col("final")).alias("conflict"))


@query(f"""WITH {_SEG}, a AS (SELECT doc_id AS case_id, {_ASKED} AS question, seg_idx AS pos, CASE WHEN seg_idx % 4 = 3 THEN 'withdrawn' ELSE 'user_confirmed' END AS status FROM seg)
SELECT case_id, question, pos, CASE WHEN status = 'user_confirmed' AND pos < max(pos) FILTER (WHERE status = 'user_confirmed') OVER (PARTITION BY case_id, question) THEN 'superseded' ELSE status END AS status FROM a""")
def superseded_answers(spark, d):
    return human.current(_segments(spark, d).selectExpr("doc_id AS case_id", f"{_ASKED} AS question", "seg_idx AS pos", "CASE WHEN seg_idx % 4 = 3 THEN 'withdrawn' ELSE 'user_confirmed' END AS status"))


@query(f"""WITH {_SEG}, q AS (SELECT doc_id, list(DISTINCT {_ASKED}) AS asked FROM seg WHERE seg_idx % 4 <> 3 AND seg_idx > 1 GROUP BY doc_id), a AS (SELECT doc_id AS case_id, doc_id % 3 <> 0 AS changed, coalesce(asked, []) AS asked FROM documents LEFT JOIN q USING (doc_id)),
f AS (SELECT *, changed AND list_contains(asked, 'repair_reason') AS r, changed AND list_contains(asked, 'reader_response') AS d FROM a)
SELECT case_id, CASE WHEN changed AND len(asked) > 0 THEN 'source_final_plus_author_rationale' ELSE 'source_final_only' END AS level, array_to_string(list_sort(list_concat(list_concat(['textual_analysis'], CASE WHEN r THEN ['translator_rationale', 'decision_reasoning'] ELSE [] END), CASE WHEN d THEN ['reader_response_claim'] ELSE [] END)), ',') AS can,
CASE WHEN r THEN 'initial_failure_reasoning' ELSE 'initial_failure_reasoning,process_claims' END AS cannot FROM f""")
def case_capabilities(spark, d):
    adequacy = _docs(spark, d).select(F.col("doc_id").alias("case_id"), F.lit("source_final_only").alias("level"), F.array(F.lit("textual_analysis")).alias("can"), F.array(F.lit("process_claims"), F.lit("initial_failure_reasoning")).alias("cannot"), (F.col("doc_id") % 3 != 0).alias("changed"))
    answers = _segments(spark, d).filter("seg_idx > 1").selectExpr("doc_id AS case_id", f"{_ASKED} AS question", "CASE WHEN seg_idx % 4 = 3 THEN 'withdrawn' ELSE 'user_confirmed' END AS status")
    found = human.capabilities(adequacy, answers)
    return found.select("case_id", "level", F.array_join("can", ",").alias("can"), F.array_join("cannot", ",").alias("cannot"))


_PARTS = {"problem": "doc_id % 2 = 0", "grounded": "doc_id % 3 = 0", "changed": "doc_id % 4 = 0", "failure": "doc_id % 5 = 0", "alternatives": "doc_id % 6 = 0", "rationale": "doc_id % 7 < 3", "effect": "doc_id % 8 < 4", "theory": "CASE WHEN doc_id % 9 = 0 THEN 'weak' END", "boundary": "doc_id % 10 < 5", "conclusion": "doc_id % 11 < 5", "level": "CASE WHEN doc_id % 3 = 1 THEN 'source_final_only' ELSE 'partial_process_evidence' END"}


@query(f"""WITH p AS (SELECT doc_id AS case_id, {", ".join(f"{x} AS {n}" for n, x in _PARTS.items())} FROM documents), s AS (SELECT case_id, CASE WHEN problem AND grounded THEN 'strong' WHEN problem THEN 'weak' ELSE 'missing' END AS translation_problem,
CASE WHEN changed THEN 'strong' WHEN level = 'source_final_only' THEN 'not_applicable' ELSE 'weak' END AS difficulty_evidence, CASE WHEN failure THEN 'strong' WHEN level = 'source_final_only' THEN 'not_applicable' ELSE 'missing' END AS initial_solution_or_failure, CASE WHEN alternatives THEN 'adequate' ELSE 'missing' END AS alternative_interpretation_or_strategy,
CASE WHEN rationale THEN 'strong' ELSE 'weak' END AS final_translation_decision, CASE WHEN rationale THEN 'strong' ELSE 'missing' END AS decision_rationale, CASE WHEN effect THEN 'strong' ELSE 'missing' END AS translation_effect, coalesce(theory, 'not_applicable') AS theory_connection, CASE WHEN boundary THEN 'adequate' ELSE 'weak' END AS evidence_boundary,
CASE WHEN conclusion THEN 'strong' ELSE 'missing' END AS case_level_conclusion FROM p) UNPIVOT s ON * EXCLUDE (case_id) INTO NAME part VALUE status""")
def contract_completion(spark, d):
    return human.completion(_docs(spark, d).selectExpr("doc_id AS case_id", *[f"{x} AS {n}" for n, x in _PARTS.items()]))
