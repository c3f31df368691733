"""Queries that check records; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import records
from glossweave.plans.catalogue import _SEG, _docs, _segments, query

# Profiles of documents, with what a model may get wrong: blanks, numbers that are none, sections that are no ranges.
_PROFILE = {
    "domain": "CASE WHEN doc_id % 6 = 1 THEN ' ' ELSE source END", "subdomain": "lang", "genre": "CAST(NULL AS STRING)", "audience": "' all '", "register": "''", "style_constraints": "''", "confidence": "CASE doc_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN '0.1' WHEN 2 THEN CAST(NULL AS STRING) ELSE ' 0.7' END",
}
_SECTION = {"section_id": "CASE WHEN seg_idx % 3 = 0 THEN ' ' ELSE 's' || seg_idx END", "start_segment": "CASE WHEN seg_idx % 7 = 2 THEN 'first' ELSE CAST(seg_idx AS STRING) END", "end_segment": "CAST(seg_idx + 2 - seg_idx % 5 AS STRING)", "topic": "CASE WHEN seg_idx % 4 = 1 THEN '' ELSE 'topic' END", "domain": "' '"}


@query(f"""WITH {_SEG}, x AS (SELECT doc_id, seg_idx AS i, {', '.join(f'{v} AS {k}' for k, v in _SECTION.items())} FROM seg), r AS (SELECT doc_id, CASE WHEN trim(section_id) = '' THEN 'section-' || (i + 1) ELSE section_id END AS name, topic FROM x WHERE try_cast(start_segment AS INT) >= 0 AND try_cast(end_segment AS INT) >= try_cast(start_segment AS INT)),
p AS (SELECT doc_id, trim({_PROFILE['domain']}) AS domain, coalesce(try_cast(trim({_PROFILE['confidence']}) AS DOUBLE), 0) AS confidence FROM documents)
SELECT doc_id, 'missing_domain' AS error FROM p WHERE domain = '' UNION ALL SELECT doc_id, 'low_confidence' FROM p WHERE confidence < 0.2 UNION ALL SELECT doc_id, 'bare_section:' || name FROM r WHERE topic = ''""".replace("AS STRING", "AS VARCHAR"))
def document_profile_errors(spark, d):
    docs = _docs(spark, d).select("doc_id", *[F.expr(x).alias(c) for c, x in _PROFILE.items()])
    listed = _segments(spark, d).select("doc_id", "seg_idx", F.struct(*[F.expr(x).alias(c) for c, x in _SECTION.items()]).alias("x")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "x"))), lambda y: y["x"]).alias("sections"))
    return records.profile_errors(records.document_profiles(docs.join(listed, "doc_id", "left")), "doc_id")


_EVIDENCE = {
    "evidence_type": "CASE seg_idx % 7 WHEN 0 THEN 'user' WHEN 1 THEN 'external' WHEN 2 THEN 'model_knowledge' WHEN 3 THEN 'local_termbase' WHEN 4 THEN 'hearsay' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'project_override' END", "url": "CASE WHEN length(text) % 2 = 0 THEN 'https://example.org/' || seg_idx ELSE '' END",
    "source_name": "CASE WHEN length(text) % 3 = 0 THEN NULL ELSE 'a source' END",
}


@query(f"""WITH {_SEG}, e AS (SELECT doc_id || '-' || seg_idx AS evidence_id, {', '.join(f'{v} AS {k}' for k, v in _EVIDENCE.items())} FROM seg)
SELECT evidence_id, 'unknown_type' AS error FROM e WHERE evidence_type IS NULL OR evidence_type = 'hearsay' UNION ALL SELECT evidence_id, 'model_with_url' FROM e WHERE evidence_type = 'model_knowledge' AND url <> '' UNION ALL SELECT evidence_id, 'external_without_url' FROM e WHERE evidence_type = 'external' AND url = ''
UNION ALL SELECT evidence_id, 'missing_source_name' FROM e WHERE evidence_type IN ('user', 'local_termbase', 'project_override') AND source_name IS NULL""".replace("AS STRING", "AS VARCHAR"))
def evidence_record_errors(spark, d):
    own = _segments(spark, d).selectExpr("doc_id || '-' || seg_idx AS evidence_id", *[f"{x} AS {c}" for c, x in _EVIDENCE.items()])
    return records.evidence_errors(own, "evidence_id")


# Every document freezes a glossary of its longer words; some are empty, some changed after that, some have no time.
_WORD = "[A-Za-z]{9,}"
_ENTRY = {"preferred": "CASE WHEN length(word) % 5 = 0 THEN '' ELSE lower(word) END", "behavior": "CASE WHEN length(word) % 4 = 0 THEN 'preserve' ELSE 'translate' END", "status": "CASE length(word) % 3 WHEN 0 THEN 'locked' WHEN 1 THEN 'odd' ELSE 'provisional' END"}


@query(f"""WITH w AS (SELECT DISTINCT doc_id AS version, unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM documents), e AS (SELECT version, word, {', '.join(f'{v} AS {k}' for k, v in _ENTRY.items())} FROM w),
h AS (SELECT version, sha256(string_agg(r, chr(10) ORDER BY r)) AS hash FROM (SELECT version, sha256(word || '|' || preferred || '|' || behavior || '|' || status) AS r FROM e) GROUP BY version)
SELECT doc_id AS version, 'empty' AS error FROM documents WHERE doc_id NOT IN (SELECT version FROM e) UNION ALL SELECT version, 'hash_mismatch' FROM h WHERE version % 7 = 3 UNION ALL SELECT doc_id, 'hash_mismatch' FROM documents WHERE doc_id % 7 = 3 AND doc_id NOT IN (SELECT version FROM h) UNION ALL SELECT doc_id, 'missing_time' FROM documents WHERE doc_id % 9 = 4
UNION ALL SELECT version, 'unknown_status:' || word FROM e WHERE status = 'odd' UNION ALL SELECT version, 'translate_without_preferred:' || word FROM e WHERE behavior = 'translate' AND preferred = '' UNION ALL SELECT version, 'locked_without_preferred:' || word FROM e WHERE status = 'locked' AND preferred = ''""")
def frozen_glossary_errors(spark, d):
    docs = _docs(spark, d)
    words = docs.select(F.col("doc_id").alias("version"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word"))
    entries = words.selectExpr("version", "word AS entry_id", "word AS source", *[f"{x} AS {c}" for c, x in _ENTRY.items()])
    right = entries.groupBy("version").agg(records.entries_hash().alias("h"))
    frozen = docs.select(F.col("doc_id").alias("version"), F.when(F.col("doc_id") % 9 != 4, "2020-01-01T00:00:00").alias("frozen_at")).join(right, "version", "left")
    frozen = frozen.withColumn("glossary_hash", F.when(F.col("version") % 7 == 3, "x").otherwise(F.coalesce("h", F.sha2(F.lit(""), 256)))).drop("h")
    return records.frozen_errors(frozen, entries)
