"""Queries over the chain of literature; they join the catalogue's. Documents are sources, their longer segments evidence and claims; some links are broken. Expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import chain
from glossweave.plans.catalogue import _SEG, _docs, _segments, query
from glossweave.sources import derived

_EV = {
    "evidence_id": "'E' || doc_id || '-' || seg_idx", "source_id": "CASE WHEN seg_idx % 11 = 3 THEN 'gone' ELSE 'S' || doc_id END", "source_hash": "CASE WHEN seg_idx % 13 = 4 THEN 'x' ELSE 'h' || doc_id END", "evidence_type": "CASE WHEN seg_idx % 7 = 5 THEN 'metadata_only' ELSE 'quote' END",
    "block_id": "CASE WHEN seg_idx % 17 = 6 THEN 'none' ELSE 'B' || doc_id || '-' || seg_idx END", "location": "CASE WHEN seg_idx % 19 = 7 THEN 'elsewhere' ELSE 'p' || seg_idx END", "text": "CASE WHEN seg_idx % 23 = 8 THEN 'changed' ELSE text END", "eligible": "seg_idx % 6 <> 1",
}
_LC = {"claim_id": "'LC' || doc_id || '-' || seg_idx", "source_id": "CASE WHEN seg_idx % 15 = 9 THEN 'gone' ELSE 'S' || doc_id END"}
_GC = {"claim_id": "'G' || doc_id", "support_category": "CASE doc_id % 3 WHEN 0 THEN 'literature_supported' WHEN 1 THEN 'mixed_evidence' ELSE 'project' END"}
_LITC = ["CASE WHEN doc_id % 10 <> 9 THEN 'LC' || doc_id || '-0' END", "CASE WHEN doc_id % 10 <> 9 THEN 'LC' || doc_id || '-3' END", "CASE WHEN doc_id % 5 = 0 THEN 'LC-none' END"]
_LITE = ["CASE WHEN doc_id % 10 <> 9 THEN 'E' || doc_id || '-0' END", "CASE WHEN doc_id % 4 = 0 THEN 'S' || doc_id END", "CASE WHEN doc_id % 6 = 1 THEN 'E-none' END", "CASE WHEN doc_id % 7 = 2 THEN 'E' || doc_id || '-2' END"]
_LONG = "length(text) >= 60"
_CHAIN = f"""WITH {_SEG}, so AS (SELECT 'S' || doc_id AS source_id, 'h' || doc_id AS content_hash FROM documents), bk AS (SELECT 'S' || doc_id AS source_id, 'B' || doc_id || '-' || seg_idx AS block_id, 'p' || seg_idx AS location, text FROM seg),
ev AS (SELECT {', '.join(f'{x} AS {name}' for name, x in _EV.items())} FROM seg WHERE {_LONG}), lc AS (SELECT {', '.join(f'{x} AS {name}' for name, x in _LC.items())}, CASE WHEN seg_idx % 12 = 0 AND seg_idx > 0 THEN [] ELSE ['E' || doc_id || '-' || seg_idx, 'E' || doc_id || '-' || (seg_idx + 1)] END AS supports FROM seg WHERE {_LONG} AND seg_idx % 3 = 0),
gc AS (SELECT doc_id, {', '.join(f'{x} AS {name}' for name, x in _GC.items())}, list_filter([{', '.join(_LITC)}], lambda x: x IS NOT NULL) AS literature_claims, list_filter([{', '.join(_LITE)}], lambda x: x IS NOT NULL) AS literature_evidence FROM documents),
sn AS (SELECT doc_id, 'sec-' || doc_id || '-' || k AS section_id, k, CASE WHEN k = 1 THEN [] ELSE ['G' || doc_id] END AS claims FROM documents, range(3) t(k)),
su AS (SELECT claim_id, source_id AS own, unnest(supports) AS evidence_id FROM lc), ga AS (SELECT claim_id, unnest(literature_claims) AS lcid FROM gc), ge AS (SELECT claim_id, unnest(literature_evidence) AS evidence_id FROM gc)"""


def _dealt(spark, d):
    docs = derived.table(spark, d, "documents")
    return lambda df, *keys: derived.dealt(df, docs, *keys)


def _tables(spark, d):
    docs, segs = _docs(spark, d), _segments(spark, d)
    sources = docs.selectExpr("'S' || doc_id AS source_id", "'h' || doc_id AS content_hash")
    blocks = segs.selectExpr("'S' || doc_id AS source_id", "'B' || doc_id || '-' || seg_idx AS block_id", "'p' || seg_idx AS location", "text")
    long = segs.filter(_LONG)
    evidence = long.selectExpr(*[f"{x} AS {name}" for name, x in _EV.items()])
    supports = "CASE WHEN seg_idx % 12 = 0 AND seg_idx > 0 THEN CAST(array() AS array<string>) ELSE array('E' || doc_id || '-' || seg_idx, 'E' || doc_id || '-' || (seg_idx + 1)) END AS supports"
    claims = long.filter("seg_idx % 3 = 0").selectExpr(*[f"{x} AS {name}" for name, x in _LC.items()], supports)
    listed = lambda xs, name: F.array_compact(F.array(*map(F.expr, xs))).alias(name)
    global_ = docs.select(*[F.expr(x).alias(name) for name, x in _GC.items()], listed(_LITC, "literature_claims"), listed(_LITE, "literature_evidence"))
    sections = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).selectExpr("doc_id", "k", "'sec-' || doc_id || '-' || k AS section_id", "CASE WHEN k = 1 THEN CAST(array() AS array<string>) ELSE array('G' || doc_id) END AS claims")
    return sources, blocks, evidence, claims, global_, sections


@query(f"""{_CHAIN}, wh AS (SELECT ev.* FROM ev JOIN so USING (source_id) WHERE evidence_type <> 'metadata_only'), wb AS (SELECT wh.*, bk.block_id AS there, bk.location AS bl, bk.text AS bt FROM wh LEFT JOIN bk ON bk.source_id = wh.source_id AND bk.block_id = wh.block_id)
SELECT 'literature_evidence_source_missing' AS type, evidence_id AS subject, source_id AS ref FROM ev WHERE source_id NOT IN (SELECT source_id FROM so) UNION ALL SELECT 'literature_source_hash_mismatch', evidence_id, source_id FROM ev JOIN so USING (source_id) WHERE source_hash <> content_hash
UNION ALL SELECT 'invalid_literature_location', evidence_id, block_id FROM wb WHERE there IS NULL UNION ALL SELECT 'invalid_literature_location', evidence_id, location FROM wb WHERE there IS NOT NULL AND location <> bl UNION ALL SELECT 'literature_evidence_text_mismatch', evidence_id, block_id FROM wb WHERE there IS NOT NULL AND text <> bt
UNION ALL SELECT 'literature_claim_source_missing', claim_id, source_id FROM lc WHERE source_id NOT IN (SELECT source_id FROM so) UNION ALL SELECT 'literature_claim_without_evidence', claim_id, source_id FROM lc WHERE len(supports) = 0 UNION ALL SELECT 'literature_claim_unknown_evidence', claim_id, evidence_id FROM su WHERE evidence_id NOT IN (SELECT evidence_id FROM ev)
UNION ALL SELECT 'literature_claim_evidence_mismatch', claim_id, evidence_id FROM su JOIN ev USING (evidence_id) WHERE ev.source_id <> own OR NOT eligible UNION ALL SELECT 'global_claim_unknown_literature_claim', claim_id, lcid FROM ga WHERE lcid NOT IN (SELECT claim_id FROM lc)
UNION ALL SELECT 'argument_plan_source_id_without_grounding', claim_id, evidence_id FROM ge WHERE evidence_id IN (SELECT source_id FROM so) UNION ALL SELECT 'global_claim_unknown_literature_evidence', claim_id, evidence_id FROM ge WHERE evidence_id NOT IN (SELECT source_id FROM so) AND evidence_id NOT IN (SELECT evidence_id FROM ev)
UNION ALL SELECT 'global_claim_literature_support_mismatch', claim_id, evidence_id FROM ge WHERE evidence_id IN (SELECT evidence_id FROM ev) AND NOT EXISTS (SELECT 1 FROM ga JOIN su ON su.claim_id = lcid WHERE ga.claim_id = ge.claim_id AND su.evidence_id = ge.evidence_id)
UNION ALL SELECT 'global_claim_missing_literature_grounding', claim_id, support_category FROM gc WHERE support_category <> 'project' AND (len(literature_claims) = 0 OR len(literature_evidence) = 0)""")
def literature_chain_violations(spark, d):
    return chain.chain_violations(*_tables(spark, d)[:5], deal=_dealt(spark, d))


@query(f"""{_CHAIN}, re AS (SELECT DISTINCT lc.source_id, ga.claim_id FROM lc JOIN ga ON lcid = lc.claim_id), pl AS (SELECT DISTINCT source_id, section_id FROM re JOIN (SELECT section_id, unnest(claims) AS claim_id FROM sn) USING (claim_id))
SELECT source_id, (SELECT count(*) FROM ev WHERE ev.source_id = so.source_id) AS n_evidence, (SELECT count(*) FROM lc WHERE lc.source_id = so.source_id) AS n_literature_claims, (SELECT count(*) FROM re WHERE re.source_id = so.source_id) AS n_global_claims, (SELECT count(*) FROM pl WHERE pl.source_id = so.source_id) AS n_sections FROM so""")
def literature_lineage(spark, d):
    sources, _, evidence, claims, global_, sections = _tables(spark, d)
    return chain.lineage(sources, evidence, claims, global_, sections)


# Outlines of three sections: a document's segments are claims of the first, the second or no section by their number, and cases that claims name or that none does.

@query(f"""{_CHAIN}, cl AS (SELECT doc_id, seg_idx, 'C' || doc_id || '-' || seg_idx AS claim_id, seg_idx % 4 AS of, CASE WHEN seg_idx % 5 = 4 THEN [] ELSE ['K' || doc_id || '-' || (seg_idx % 6), 'K' || doc_id || '-' || (seg_idx % 4)] END AS cases, ['LC' || doc_id || '-' || seg_idx] AS lcs, ['E' || doc_id || '-' || seg_idx] AS les FROM seg),
ca AS (SELECT DISTINCT doc_id, 'K' || doc_id || '-' || (seg_idx % 9) AS case_id, seg_idx % 9 = 7 AS synthetic, seg_idx % 9 AS k FROM seg), ss AS (SELECT DISTINCT doc_id, k, 'sec-' || doc_id || '-' || k AS section_id FROM seg, range(3) t(k)),
pc AS (SELECT ss.doc_id, ss.k, section_id, claim_id FROM ss JOIN cl ON cl.doc_id = ss.doc_id AND cl.of = ss.k AND ss.k < 2), al AS (SELECT doc_id, section_id, claim_id FROM pc UNION SELECT ss.doc_id, section_id, claim_id FROM ss JOIN cl ON cl.doc_id = ss.doc_id AND ss.k = 2 AND cl.of >= 2),
fr AS (SELECT * FROM ca WHERE k > 0), cn AS (SELECT DISTINCT doc_id, claim_id, unnest(cases) AS case_id FROM cl),
ov AS (SELECT fr.doc_id, fr.case_id, ss.section_id, ss.k, (SELECT count(*) FROM cn JOIN pc USING (doc_id, claim_id) WHERE cn.doc_id = fr.doc_id AND cn.case_id = fr.case_id AND pc.k = ss.k) AS n FROM fr JOIN ss ON ss.doc_id = fr.doc_id WHERE NOT synthetic AND EXISTS (SELECT 1 FROM cn WHERE cn.doc_id = fr.doc_id AND cn.case_id = fr.case_id)),
bs AS (SELECT doc_id, case_id, first(section_id ORDER BY n DESC, k) AS section_id FROM ov GROUP BY ALL)
SELECT doc_id, section_id, 'research_question' AS kind, 'q' || i AS ref FROM ss, range(2) t(i) UNION ALL SELECT doc_id, section_id, 'claim', claim_id FROM al
UNION ALL SELECT doc_id, section_id, 'case', case_id FROM bs UNION ALL SELECT ss.doc_id, section_id, 'case', case_id FROM fr JOIN ss ON ss.doc_id = fr.doc_id AND ss.k = 2 WHERE synthetic UNION ALL SELECT ss.doc_id, section_id, 'case', case_id FROM ca JOIN ss ON ss.doc_id = ca.doc_id AND ss.k = 0 WHERE ca.k = 0
UNION ALL SELECT DISTINCT al.doc_id, section_id, 'literature_claim', unnest(lcs) FROM al JOIN cl USING (doc_id, claim_id) UNION ALL SELECT DISTINCT al.doc_id, section_id, 'literature_evidence', unnest(les) FROM al JOIN cl USING (doc_id, claim_id)
UNION ALL SELECT DISTINCT x.doc_id, section_id, 'literature_source', source_id FROM (SELECT al.doc_id, section_id, unnest(les) AS e FROM al JOIN cl USING (doc_id, claim_id)) x JOIN ev ON e = evidence_id""")
def closed_outlines(spark, d):
    segs, deal = _segments(spark, d), _dealt(spark, d)
    claims = segs.selectExpr("doc_id", "'C' || doc_id || '-' || seg_idx AS claim_id", "seg_idx % 4 AS of", "CASE WHEN seg_idx % 5 = 4 THEN CAST(array() AS array<string>) ELSE array_distinct(array('K' || doc_id || '-' || (seg_idx % 6), 'K' || doc_id || '-' || (seg_idx % 4))) END AS cases", "array('LC' || doc_id || '-' || seg_idx) AS literature_claims", "array('E' || doc_id || '-' || seg_idx) AS literature_evidence")
    cases = segs.selectExpr("doc_id", "'K' || doc_id || '-' || (seg_idx % 9) AS case_id", "seg_idx % 9 = 7 AS synthetic").distinct()
    docs = segs.select("doc_id").distinct()
    planned = deal(claims.filter("of < 2").select("doc_id", "of", "claim_id"), "doc_id", "of").groupBy("doc_id", F.col("of").alias("pos")).agg(F.collect_list("claim_id").alias("claims"))
    none = F.array().cast("array<string>")
    sections = deal(docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")), "doc_id", "pos").join(planned, ["doc_id", "pos"], "left")
    first = cases.filter("NOT synthetic AND case_id LIKE '%-0'").select("doc_id", F.lit(0).alias("pos"), F.array("case_id").alias("cases"))
    sections = sections.join(first, ["doc_id", "pos"], "left").select("doc_id", F.concat_ws("-", F.lit("sec"), "doc_id", "pos").alias("section_id"), "pos", F.coalesce("claims", none).alias("claims"), F.coalesce("cases", none).alias("cases"))
    questions = docs.select("doc_id", F.explode(F.array(F.lit("q0"), F.lit("q1"))).alias("rq"))
    return chain.closed_outline(sections, claims.drop("of"), questions, cases, _tables(spark, d)[2].select("evidence_id", "source_id"), deal=deal)
