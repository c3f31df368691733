"""Queries over requests, plans, hashes and report lines; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import lookups
from glossweave.plans.catalogue import _G, _PAIRS, _SEG, _docs, _pairs, _segments, query
from glossweave.sources import derived, jobs
from glossweave.sources.jobs import FINDING_SQL

_ASKED = {"tool": "CASE seg_idx % 5 WHEN 0 THEN 'segment' WHEN 1 THEN 'neighbors' WHEN 2 THEN 'term' WHEN 3 THEN 'shell' ELSE 'segment' END", "arg": "CASE seg_idx % 5 WHEN 2 THEN 'de' WHEN 4 THEN 'none' ELSE CAST(seg_idx % 3 AS STRING) END", "pos": "seg_idx"}
_REQUESTS = f"""a AS (SELECT doc_id, {", ".join(f"{x} AS {n}" for n, x in _ASKED.items())} FROM seg), o AS (SELECT doc_id, tool, arg, min(pos) AS pos FROM a WHERE tool <> 'shell' GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos))::INT AS n FROM o QUALIFY n <= 5),
p AS (SELECT r.doc_id, n, s.seg_idx, s.text AS part FROM r JOIN seg s ON s.doc_id = r.doc_id AND CASE tool WHEN 'segment' THEN s.seg_idx = try_cast(arg AS INT) WHEN 'neighbors' THEN abs(s.seg_idx - try_cast(arg AS INT)) <= 2 END
UNION ALL SELECT r.doc_id, n, s.seg_idx, s.seg_idx::VARCHAR FROM r JOIN seg s ON s.doc_id = r.doc_id AND tool = 'term' AND contains(' ' || s.text || ' ', ' ' || arg || ' ')),
f AS (SELECT *, sum(strlen(part) + 1) OVER (PARTITION BY doc_id, n ORDER BY seg_idx) <= 24001 AS fits FROM p), g2 AS (SELECT doc_id, n, coalesce(string_agg(part, chr(10) ORDER BY seg_idx) FILTER (WHERE fits), '') AS answer, bool_or(NOT fits) AS cut FROM f GROUP BY doc_id, n)"""


@query(f"WITH {_SEG}, {_REQUESTS} SELECT r.doc_id, r.n, tool, arg, md5(answer) AS answer_hash, coalesce(cut, false) AS cut FROM r LEFT JOIN g2 ON g2.doc_id = r.doc_id AND g2.n = r.n")
def evidence_requests(spark, d):
    segs = _segments(spark, d)
    asked = lookups.requests(segs.selectExpr("doc_id", *[f"{x} AS {n}" for n, x in _ASKED.items()]))
    held = segs.filter(F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.lit(" de "))).select("doc_id", F.lit("de").alias("term"), "seg_idx")
    return lookups.answer(asked, segs, held).select("doc_id", "n", "tool", "arg", F.md5("answer").alias("answer_hash"), "cut")


@query(f"""WITH {_SEG}, p AS (SELECT doc_id AS case_id, CASE WHEN seg_idx % 2 = 0 THEN 'p' || seg_idx END AS problem, 'f' || seg_idx AS failure, 'r' || seg_idx AS rationale, seg_idx AS pos FROM seg WHERE doc_id % 3 <> 0),
f AS (SELECT case_id, min_by(problem, pos) AS problem, min_by(failure, pos) AS failure, min_by(rationale, pos) AS rationale FROM p GROUP BY case_id)
SELECT doc_id AS case_id, f.case_id IS NOT NULL AS planned, coalesce(problem, '') AS problem, CASE WHEN doc_id % 4 <> 0 THEN failure END AS failure, CASE WHEN doc_id % 5 <> 0 THEN rationale END AS rationale FROM documents LEFT JOIN f ON f.case_id = doc_id""")
def case_plan_completion(spark, d):
    plans = _segments(spark, d).filter("doc_id % 3 <> 0").selectExpr("doc_id AS case_id", "CASE WHEN seg_idx % 2 = 0 THEN 'p' || seg_idx END AS problem", "'f' || seg_idx AS failure", "'r' || seg_idx AS rationale", "seg_idx AS pos")
    docs = _docs(spark, d)
    cannot = docs.selectExpr("doc_id AS case_id", "explode(array_compact(array(CASE WHEN doc_id % 4 = 0 THEN 'initial_failure_reasoning' END, CASE WHEN doc_id % 5 = 0 THEN 'process_claims' END))) AS what")
    return lookups.case_plans(docs.selectExpr("doc_id AS case_id"), plans, cannot)


@query("""SELECT 'literature_source_content_hash_mismatch' AS type, 's' || doc_id AS subject FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'literature_source_hash_mismatch', 'e' || doc_id FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0)
UNION ALL SELECT 'literature_evidence_hash_mismatch', 'e' || doc_id FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT 'literature_claim_hash_mismatch', 'c' || doc_id FROM documents WHERE doc_id % 17 = 0""")
def literature_hash_violations(spark, d):
    docs = _docs(spark, d)
    wrong = lambda n, x: F.when(F.col("doc_id") % n == 0, "stale").otherwise(x)
    own = docs.select("doc_id", F.concat(F.lit("s"), "doc_id").alias("source_id"), F.concat(F.lit("e"), "doc_id").alias("evidence_id"), F.concat(F.lit("c"), "doc_id").alias("claim_id"), "text", F.col("text").alias("line"))
    sources = own.select("source_id", "text", wrong(7, F.sha2("text", 256)).alias("content_hash"))
    evidence = own.select("evidence_id", "source_id", F.col("line").alias("text"), wrong(11, F.sha2("text", 256)).alias("source_hash"), wrong(13, F.sha2(F.concat_ws("|", "source_id", "line"), 256)).alias("content_hash"))
    claims = own.select("claim_id", F.lit("says").alias("statement"), "evidence_id", wrong(17, F.sha2(F.concat_ws("|", F.lit("says"), "evidence_id"), 256)).alias("content_hash"))
    return lookups.hash_violations(sources, evidence, claims)


@query(f"WITH {_SEG}, {_G} SELECT doc_id, seg_idx, 'domain' AS type, id, '术语：' || g.source AS note FROM seg JOIN g ON length(g.source) >= 2 AND contains(text, g.source)")
def glossary_annotations(spark, d):
    return lookups.term_notes(_segments(spark, d), derived.glossary(spark))


@query(f"""WITH {FINDING_SQL} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY list_position(['blocking', 'actionable', 'informational'], severity), event_id))::INT AS n, '- [' || CASE WHEN resolved THEN 'x' ELSE ' ' END || '] ' || severity || ' ' || conv_id || ':' || seg_idx || ' ' || type AS line FROM fd""")
def findings_report(spark, d):
    return lookups.report_lines(jobs.findings(spark, d))


@query(f"""WITH {_PAIRS}, {_G} SELECT conv_id, seg_idx, id, strpos(p.source, g.source)::INT - 1 AS src_start, strpos(p.source, g.source)::INT - 1 + length(g.source)::INT AS src_end, CASE WHEN preferred <> '' AND contains(target, preferred) THEN strpos(target, preferred)::INT - 1 END AS tgt_start,
CASE WHEN preferred <> '' AND contains(target, preferred) THEN strpos(target, preferred)::INT - 1 + length(preferred)::INT END AS tgt_end, '术语：' || g.source || ' -> ' || CASE WHEN preferred = '' THEN '保留原文' ELSE preferred END AS note FROM pairs p JOIN g ON length(g.source) >= 2 AND contains(p.source, g.source)""")
def glossary_spans(spark, d):
    return lookups.term_spans(_pairs(spark, d), derived.glossary(spark), "conv_id", "seg_idx")


# Annotations as a document's state holds them: of every segment its long words, some twice, some under keys that are no places, some values no lists.
_TYPE = "CASE length(w) % 3 WHEN 0 THEN 'rare' WHEN 1 THEN 'domain' ELSE 'hard' END"


@query(f"""WITH {_SEG}, ws AS (SELECT doc_id AS job, seg_idx, unnest(range(len(x))) AS k, unnest(x) AS w FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]{{7,}}') AS x FROM seg WHERE seg_idx % 6 < 4)),
f AS (SELECT job, seg_idx, {_TYPE} AS type, length(w)::INT AS a, min(k) AS k FROM ws GROUP BY ALL), n AS (SELECT *, (row_number() OVER (PARTITION BY job, seg_idx, type ORDER BY k))::INT AS n FROM f) SELECT job, seg_idx, n, type, [a] AS src_span FROM n WHERE n <= CASE type WHEN 'hard' THEN 2 ELSE 3 END""")
def stored_annotations(spark, d):
    segs = _segments(spark, d)
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))
    kind = lambda w: F.when(F.length(w) % 3 == 0, "rare").when(F.length(w) % 3 == 1, "domain").otherwise("hard")
    items = F.transform(words, lambda w: F.struct(kind(w).alias("type"), F.array(F.length(w)).alias("src_span"), w.alias("note")))
    c = F.col("seg_idx")
    key = F.when(c % 6 == 5, F.concat(F.lit("p"), c)).when(c % 3 == 1, F.concat(F.lit(" "), c)).otherwise(c.cast("string"))
    value = F.when(c % 6 == 4, F.lit('"none"')).otherwise(F.to_json(items))
    entry = segs.select("doc_id", c, F.concat(F.lit('"'), key, F.lit('": '), value).alias("e")).unionByName(segs.filter("seg_idx = 0").selectExpr("doc_id", "-1 AS seg_idx", """'"100000": [{"type": "rare"}], "-1": [{"type": "hard"}]' AS e"""))
    entry = derived.dealt(entry, derived.table(spark, d, "documents"), "doc_id")
    notes = entry.groupBy(F.col("doc_id").alias("job")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "e"))), lambda x: x["e"]), ", "), F.lit("}")).alias("notes"))
    sizes = segs.groupBy(F.col("doc_id").alias("job")).agg(F.count("*").alias("size"))
    return lookups.annotations(notes, sizes).select("job", "seg_idx", "n", "type", "src_span")
