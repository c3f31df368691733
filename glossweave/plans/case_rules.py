"""Queries of the validator's rules over whole reports; they join the catalogue's. The SQL says what the reports were built to violate, and doesn't read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import case_rules
from glossweave.plans.catalogue import _SEG, _docs, _segments, query

_RULE = "SELECT '{}' AS type, 'error' AS severity, {} AS doc_id, NULL::INT AS seg_idx, {} AS ref FROM {}"

# Reports that name and quote their document's segments: some that don't exist, some that no section plans, some quotes wrong.
_ID = "'seg-' || doc_id || '-' || lpad(CAST({} AS STRING), 4, '0')"
_NAMED = _ID.format("CASE WHEN seg_idx % 9 = 4 THEN seg_idx + 5000 ELSE seg_idx END")
_KIND = "CASE seg_idx % 3 WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'INITIAL' ELSE 'TARGET' END"
_STORED = "CASE seg_idx % 3 WHEN 0 THEN text WHEN 1 THEN 'I ' || text ELSE 'T ' || text END"
_LINE = f"'See [' || {_NAMED} || '].' || chr(10) || ' > [' || {_KIND} || ' ' || {_ID.format('seg_idx')} || ']:  ' || CASE WHEN seg_idx % 4 = 1 THEN 'quoted wrongly' ELSE replace({_STORED}, ' ', '  ') END"
_NAMED_SQL = _NAMED.replace("AS STRING", "AS VARCHAR")


@query(f"""WITH {_SEG}, u AS (SELECT DISTINCT doc_id, seg_idx, {_NAMED_SQL} AS ref FROM seg)
{_RULE.format('invented_segment_id', 'doc_id', 'ref', "u WHERE seg_idx % 9 = 4")}
UNION ALL {_RULE.format('unplanned_segment_reference', 'doc_id', 'ref', "u WHERE seg_idx % 9 = 4 OR seg_idx % 3 = 2")}
UNION ALL SELECT CASE seg_idx % 3 WHEN 0 THEN 'wrong_segment_quote' WHEN 1 THEN 'wrong_initial_translation' ELSE 'wrong_final_translation' END, 'error', doc_id, NULL, {_ID.format('seg_idx').replace('AS STRING', 'AS VARCHAR')} FROM seg WHERE seg_idx % 4 = 1""")
def quotation_violations(spark, d):
    segs = _segments(spark, d)
    lines = segs.selectExpr("doc_id", "seg_idx", f"{_LINE} AS line")
    reports = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "line"))), lambda x: x["line"]), "\n").alias("body"))
    stored = segs.selectExpr("doc_id", f"{_ID.format('seg_idx')} AS segment_id", "text AS source", "'I ' || text AS initial_target", "'T ' || text AS target")
    return case_rules.quotation_violations(reports, stored, segs.filter("seg_idx % 3 <> 2").selectExpr("doc_id", f"{_ID.format('seg_idx')} AS segment_id"))


# Reports around a document's text that show a made-up case and say more or less of what they must.
_SC = "'SC-' || lpad(CAST(doc_id % 7 AS STRING), 4, '0')"
_PARTS = [
    "CASE WHEN doc_id % 5 < 3 THEN '<!--synthetic-methodology-->' ELSE '' END || CASE WHEN doc_id % 5 < 2 THEN '模拟初译仅供分析，不代表历史译文。' ELSE '' END", "CASE WHEN doc_id % 4 < 3 THEN '<!--synthetic-limitation-->' ELSE '' END || CASE WHEN doc_id % 4 < 2 THEN '它不能证明错误频率。' ELSE '' END",
    "CASE WHEN doc_id % 8 < 5 THEN '### 真实修订案例' ELSE '' END", "text", "CASE WHEN doc_id % 16 < 9 THEN chr(10) || '#### 合成对比案例' || chr(10) || '模拟段落。' || CASE WHEN doc_id % 16 < 4 THEN '译者的初译有误。' ELSE '' END ELSE '' END", "''",
    f"'> [SYNTHETIC_SOURCE ' || {_SC} || ']: ' || CASE WHEN doc_id % 3 = 1 THEN 'wrong' ELSE 'src  ' || (doc_id % 7) END", f"CASE WHEN doc_id % 11 = 2 THEN '' ELSE '> [SIMULATED ' || {_SC} || ']: base ' || (doc_id % 7) END", f"'> [OPTIMIZED ' || {_SC} || ']: opt ' || (doc_id % 7)",
    "CASE WHEN doc_id % 13 = 6 THEN '> [OPTIMIZED SC-9999]: none' ELSE '' END", "''", f"CASE doc_id % 6 WHEN 0 THEN 'After review, ' || {_SC} || ' changed.' WHEN 2 THEN {_SC} || ' stays.' ELSE '' END", "''", "CASE WHEN doc_id % 10 = 4 THEN '常见的人类翻译错误' ELSE '' END",
]
_SC_SQL = _SC.replace("AS STRING", "AS VARCHAR")


@query(f"""WITH r AS (SELECT doc_id, {_SC_SQL} AS sc, doc_id % 7 AS k, doc_id % 2 = 0 AS made FROM documents)
{_RULE.format('unknown_synthetic_case', 'doc_id', "'SC-9999'", "r WHERE doc_id % 13 = 6")}
UNION ALL SELECT 'unknown_synthetic_case', 'error', doc_id, NULL, sc FROM r, range(3) t(i) WHERE k >= 5 AND NOT made AND (i < 2 OR doc_id % 11 <> 2)
UNION ALL {_RULE.format('wrong_synthetic_case_quote', 'doc_id', 'sc', "r WHERE doc_id % 3 = 1 AND (k < 5 OR made)")}
UNION ALL {_RULE.format('missing_synthetic_case_quotes', 'doc_id', 'sc', "r WHERE made AND doc_id % 11 = 2")}
UNION ALL {_RULE.format('missing_synthetic_methodology_disclosure', 'doc_id', 'NULL', "r WHERE made AND doc_id % 5 >= 2")}
UNION ALL {_RULE.format('missing_synthetic_limitation_disclosure', 'doc_id', 'NULL', "r WHERE made AND doc_id % 4 >= 2")}
UNION ALL {_RULE.format('mixed_case_groups_not_visible', 'doc_id', 'NULL', "r WHERE made AND doc_id % 3 = 0 AND NOT (doc_id % 8 < 5 AND doc_id % 16 < 9)")}
UNION ALL {_RULE.format('synthetic_case_presented_as_historical', 'doc_id', 'NULL', "r WHERE made AND doc_id % 16 < 4")}
UNION ALL {_RULE.format('synthetic_case_presented_as_historical', 'doc_id', 'sc', "r WHERE made AND doc_id % 6 = 0")}
UNION ALL {_RULE.format('unsupported_human_error_frequency_claim', 'doc_id', 'NULL', "r WHERE made AND doc_id % 10 = 4 AND NOT (k < 5 AND k % 2 = 0)")}""")
def made_up_case_violations(spark, d):
    docs = _docs(spark, d)
    reports = docs.select("doc_id", F.concat_ws("\n", *map(F.expr, _PARTS)).alias("body"))
    texts = ["'src ' || {k} AS source_text", "'base ' || {k} AS baseline", "'opt ' || {k} AS optimized"]
    made = docs.filter("doc_id % 2 = 0").selectExpr("doc_id", f"{_SC} AS case_id", "true AS synthetic", *[x.format(k="(doc_id % 7)") for x in texts])
    real = docs.filter("doc_id % 3 = 0").selectExpr("doc_id", "'seg-x-0001' AS case_id", "false AS synthetic", "'' AS source_text", "'' AS baseline", "'' AS optimized")
    stored = spark.range(5).selectExpr("'SC-' || lpad(CAST(id AS STRING), 4, '0') AS case_id", *[x.format(k="id") for x in texts], "id % 2 = 0 AS empirical")
    return case_rules.made_up_case_violations(reports, made.unionByName(real), stored)


# A document's labels stand for its selection: whether made-up cases could be made, what is wanted, how many there are.
_SELECTION = {"pipeline": "CASE WHEN toxic = 1 THEN 'failed' ELSE 'complete' END", "policy": "CASE WHEN quality = 1 THEN 'synthetic_only' ELSE 'mixed' END", "n_synthetic": "doc_id % 2"}


@query(f"""WITH s AS (SELECT doc_id, {', '.join(f'{x} AS {name}' for name, x in _SELECTION.items())} FROM labels)
SELECT 'synthetic_pipeline_unavailable' AS type, 'warning' AS severity, doc_id, NULL::INT AS seg_idx, NULL::VARCHAR AS ref FROM s WHERE pipeline = 'failed' UNION ALL SELECT 'synthetic_only_without_eligible_cases', 'error', doc_id, NULL, NULL FROM s WHERE policy = 'synthetic_only' AND n_synthetic = 0""")
def selection_violations(spark, d):
    from glossweave.sources.derived import table

    return case_rules.selection_violations(table(spark, d, "labels").selectExpr("doc_id", *[f"{x} AS {name}" for name, x in _SELECTION.items()]))


# Documents as registered sources, their segments as blocks; some citations differ or leave things out, some hashes and ids are wrong.
_SOURCE = {
    "source_id": "'LS-' || doc_id", "title": "source || ' ' || doc_id", "year": "2000 + doc_id % 20", "cited_title": "CASE doc_id % 7 WHEN 1 THEN 'another' WHEN 2 THEN '' ELSE source || '  ' || doc_id END", "cited_year": "CASE doc_id % 6 WHEN 1 THEN 1999 WHEN 2 THEN NULL ELSE 2000 + doc_id % 20 END",
    "file_hash": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE md5(text) END",
}
_BLOCK = {"location": "CASE WHEN seg_idx % 5 = 0 THEN NULL ELSE 'p' || seg_idx END", "origin_id": "'o' || seg_idx", "provenance": "'source_passage'", "source_id": "'LS-' || doc_id"}


@query(f"""WITH {_SEG}, b0 AS (SELECT doc_id, seg_idx, text, {', '.join(f'{x} AS {name}' for name, x in _BLOCK.items())} FROM seg), b1 AS (SELECT *, sha256(json_object('location', location, 'origin_id', origin_id, 'provenance', provenance, 'source_id', source_id, 'text', text)::VARCHAR) AS h FROM b0),
bl AS (SELECT *, CASE WHEN seg_idx % 19 = 4 THEN 'LB-x' ELSE 'LB-' || substring(h, 1, 16) END AS block_id, CASE WHEN seg_idx % 17 = 3 THEN 'x' ELSE h END AS content_hash FROM b1)
SELECT 'literature_metadata_mismatch' AS type, 'error' AS severity, NULL::BIGINT AS doc_id, NULL::INT AS seg_idx, 'LS-' || doc_id AS ref FROM documents WHERE doc_id % 7 = 1 UNION ALL SELECT 'literature_metadata_mismatch', 'error', NULL, NULL, 'LS-' || doc_id FROM documents WHERE doc_id % 6 = 1
UNION ALL SELECT 'literature_metadata_mismatch', 'error', NULL, NULL, 'LS-' || doc_id FROM documents WHERE doc_id % 5 = 1 UNION ALL SELECT 'literature_source_block_hash_mismatch', 'error', NULL, NULL, block_id FROM bl WHERE seg_idx % 19 = 4 OR seg_idx % 17 = 3
UNION ALL SELECT 'literature_source_content_hash_mismatch', 'error', NULL, NULL, 'LS-' || doc_id FROM documents WHERE doc_id % 11 = 3 AND (doc_id % 4 <> 0 OR doc_id IN (SELECT doc_id FROM seg))""")
def literature_record_violations(spark, d):
    docs, segs = _docs(spark, d), _segments(spark, d)
    blocks = segs.selectExpr("doc_id", "seg_idx AS n", "text", *[f"{x} AS {name}" for name, x in _BLOCK.items()])
    right = F.sha2(F.to_json(F.struct("location", "origin_id", "provenance", "source_id", "text"), {"ignoreNullFields": "false"}), 256)
    blocks = blocks.withColumn("h", right).selectExpr("*", "CASE WHEN n % 19 = 4 THEN 'LB-x' ELSE 'LB-' || substring(h, 1, 16) END AS block_id", "CASE WHEN n % 17 = 3 THEN 'x' ELSE h END AS content_hash").drop("h")
    own = docs.selectExpr("doc_id", *[f"{x} AS {name}" for name, x in _SOURCE.items()], "array(lang, 'B  C') AS authors", "CASE doc_id % 5 WHEN 1 THEN array('x') WHEN 2 THEN CAST(array() AS array<string>) ELSE array(lang, 'B C') END AS cited_authors")
    listed = blocks.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "block_id", "content_hash"))), lambda x: F.struct(x["block_id"].alias("block_id"), x["content_hash"].alias("content_hash"))).alias("blocks"))
    whole = own.join(listed, "source_id", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<struct<block_id:string,content_hash:string>>")))
    hashed = F.sha2(F.to_json(F.struct(F.col("file_hash").alias("binary_hash"), "blocks"), {"ignoreNullFields": "false"}), 256)
    sources = whole.withColumn("content_hash", F.when(F.col("doc_id") % 11 == 3, "x").otherwise(hashed)).drop("blocks", "doc_id")
    return case_rules.literature_record_violations(sources, blocks.drop("doc_id")).withColumn("doc_id", F.col("doc_id").cast("long"))
