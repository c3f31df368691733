"""Queries over records: normalising, checking and exporting them; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import cases, delivery, qa, records, sequence, terms
from glossweave.operators.records import DEMOTED, FORGED, LINE_KEYS
from glossweave.plans.catalogue import _G, _HITS, _PAIRS, _SEG, _docs, _named, _segments, query
from glossweave.plans.deliveries import _RF, _SEVERE
from glossweave.sources import derived, jobs, reports
from glossweave.sources.jobs import FINDING_SQL, RECORD_SQL
from glossweave.sources.reports import values


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


def _of(df, columns: dict[str, str], *more: str):
    return df.selectExpr(*more, *[f"{x} AS {name}" for name, x in columns.items()])


_EVIDENCE = {"evidence_type": "CASE doc_id % 5 WHEN 0 THEN ' External' WHEN 1 THEN 'model_knowledge' WHEN 2 THEN 'user' WHEN 3 THEN 'hearsay' END", "url": "CASE WHEN doc_id % 3 = 0 THEN 'https://x.org/' || doc_id ELSE ' ' END", "note": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'seen' END", "source_name": "'base ' || (doc_id % 7)"}


@query(f"""WITH e AS (SELECT doc_id, {_sql(_EVIDENCE)} FROM documents), n AS (SELECT doc_id, CASE WHEN lower(trim(coalesce(evidence_type, ''), ' ')) IN ('user', 'model_knowledge', 'external') THEN lower(trim(evidence_type, ' ')) ELSE 'model_knowledge' END AS t, trim(url, ' ') AS u, note, source_name FROM e)
SELECT doc_id, CASE WHEN t = 'external' AND u = '' THEN 'model_knowledge' ELSE t END AS evidence_type, CASE WHEN t = 'model_knowledge' THEN '' ELSE u END AS url, CASE WHEN t = 'external' AND u = '' THEN '' ELSE source_name END AS source_name,
CASE WHEN t = 'model_knowledge' AND u <> '' THEN CASE WHEN note = '' THEN '' ELSE note || '；' END || '{FORGED}' WHEN t = 'external' AND u = '' THEN CASE WHEN note = '' THEN '' ELSE note || '；' END || '{DEMOTED}' ELSE note END AS note FROM n""")
def evidence_normalized(spark, d):
    return records.evidence(_of(_docs(spark, d), _EVIDENCE, "doc_id"))


_SECTIONS = {"section_id": "CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 's' || doc_id END", "start_segment": "CASE doc_id % 5 WHEN 0 THEN '-1' WHEN 1 THEN 'x' ELSE CAST(doc_id % 7 AS STRING) END", "end_segment": "CAST(doc_id % 9 AS STRING)", "pos": "doc_id"}


@query(f"""WITH s AS (SELECT {_sql(_SECTIONS)} FROM documents), n AS (SELECT pos, CASE WHEN trim(section_id, ' ') = '' THEN 'section-' || (pos + 1) ELSE section_id END AS section_id, try_cast(start_segment AS INT) AS start_segment, try_cast(end_segment AS INT) AS end_segment FROM s) SELECT * FROM n WHERE start_segment >= 0 AND end_segment >= start_segment""")
def section_profiles(spark, d):
    return records.section_profiles(_of(_docs(spark, d), _SECTIONS)).select("pos", "section_id", "start_segment", "end_segment")


_ENTRY = {"entry_id": "'t-' || doc_id", "source": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END", "behavior": "CASE doc_id % 4 WHEN 0 THEN 'preserve' WHEN 1 THEN 'ignore' ELSE 'translate' END", "status": "CASE doc_id % 5 WHEN 0 THEN 'locked' WHEN 1 THEN NULL ELSE 'provisional' END", "preferred": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END"}


@query(f"""WITH e AS (SELECT {_sql(_ENTRY)} FROM documents) SELECT entry_id, 'missing_source' AS error FROM e WHERE source = '' UNION ALL SELECT entry_id, 'unknown_behavior' FROM e WHERE behavior = 'ignore' UNION ALL SELECT entry_id, 'unknown_status' FROM e WHERE status IS NULL
UNION ALL SELECT entry_id, 'translate_without_preferred' FROM e WHERE behavior = 'translate' AND preferred = '' UNION ALL SELECT entry_id, 'locked_without_preferred' FROM e WHERE status = 'locked' AND preferred = ''""")
def glossary_entry_errors(spark, d):
    return records.entry_errors(_of(_docs(spark, d), _ENTRY))


_BATCH = "CAST(floor(seg_idx / 4.0) AS INT)"
_REVIEW = {"severity": "CASE seg_idx % 5 WHEN 0 THEN 'blocking' WHEN 1 THEN 'actionable' WHEN 2 THEN 'grave' ELSE 'informational' END", "segment_id": "CASE doc_id % 4 WHEN 0 THEN seg_idx WHEN 1 THEN seg_idx + 4 END", "local": "CASE WHEN doc_id % 4 = 2 THEN seg_idx % 4 WHEN doc_id % 4 = 3 THEN 7 END", "reason": "CASE WHEN seg_idx % 3 = 0 THEN ' ' ELSE 'why' END", "pos": "seg_idx"}


@query(f"""WITH {_SEG}, b AS (SELECT doc_id, seg_idx, {_BATCH} AS batch FROM seg), f AS (SELECT doc_id, {_BATCH} AS batch, {_sql(_REVIEW)} FROM seg), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, batch ORDER BY seg_idx) - 1 AS local FROM b),
r AS (SELECT f.doc_id, f.batch, f.pos, severity, reason, coalesce(segment_id, p.seg_idx) AS segment_id FROM f LEFT JOIN p ON f.doc_id = p.doc_id AND f.batch = p.batch AND f.local = p.local)
SELECT r.doc_id, pos, r.segment_id, CASE WHEN severity = 'grave' THEN 'invalid_severity' WHEN r.segment_id IS NULL THEN 'missing_segment_id' WHEN b.seg_idx IS NULL THEN 'unknown_segment' END AS problem, CASE WHEN trim(reason, ' ') = '' THEN '审校发现问题' ELSE reason END AS reason,
CASE WHEN pos % 7 = 6 THEN 'e9' END AS unknown_refs FROM r LEFT JOIN b ON b.doc_id = r.doc_id AND b.batch = r.batch AND b.seg_idx = r.segment_id""")
def reviewer_findings(spark, d):
    segs = _segments(spark, d)
    refs = F.array(F.concat(F.lit("e"), F.col("pos") % 7), F.when(F.col("pos") % 7 == 6, "e9").otherwise(" "))
    found = _of(segs, _REVIEW, "doc_id", f"{_BATCH} AS batch").withColumn("refs", refs)
    known = spark.range(7).selectExpr("'e' || id AS ref")
    return records.review_findings(found, segs.selectExpr("doc_id", f"{_BATCH} AS batch", "seg_idx"), known).select("doc_id", "pos", "segment_id", "problem", "reason", F.array_join("unknown_refs", ",").alias("unknown_refs"))


# values that hold tokens stay as they are
_TOKENS = [("{{STAT:total}}", "{{TERM:t1}} 1,234"), ("{{TERM:t1}}", "le [@src1] mot {{STAT:total}}"), *[(f"[@src{k}]", f"(Source {k})") for k in range(12)]]


@query(f"WITH {_SEG}, {reports.SECTION_SQL} SELECT doc_id, seg_idx, md5({'replace(' * (2 * len(_TOKENS))}body{''.join(f', {t!r}, chr({57344 + k}))' for k, (t, _) in enumerate(_TOKENS))}{''.join(f', chr({57344 + k}), {v!r})' for k, (_, v) in enumerate(_TOKENS))}) AS body_hash FROM sec")
def token_expansion(spark, d):
    expanded = records.expand(reports.sections(_segments(spark, d)), reports.registry(spark, _TOKENS, "token string, value string"), "doc_id", "seg_idx")
    return expanded.select("doc_id", "seg_idx", F.md5("body").alias("body_hash"))


@query(f"""WITH {_SEG}, b AS (SELECT doc_id, {_BATCH} AS batch, min(seg_idx) AS first, max(seg_idx) AS last FROM seg GROUP BY ALL), s AS (SELECT doc_id, 's' || k AS section_id, k * 6 AS a, k * 6 + 9 AS z FROM documents, range(20) t(k))
SELECT b.doc_id, b.batch, arg_min(section_id, a) AS section_id FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND a <= first AND last <= z GROUP BY ALL""")
def batch_sections(spark, d):
    batches = _segments(spark, d).groupBy("doc_id", F.expr(_BATCH).alias("batch")).agg(F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"))
    sections = _docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")).selectExpr("doc_id", "'s' || k AS section_id", "k * 6 AS start_segment", "k * 6 + 9 AS end_segment")
    return records.batch_sections(batches, sections)


@query(f"""WITH {_PAIRS}, {_G}, e AS (SELECT conv_id, seg_idx, unnest(['t' || (conv_id % 9 + 1), 't99', 't' || (seg_idx % 5 + 1)]) AS id, unnest([0, 1, 2]) AS n FROM pairs), j AS (SELECT conv_id, seg_idx, string_agg(source, ',' ORDER BY n) AS terms FROM e JOIN g USING (id) GROUP BY ALL) SELECT conv_id, seg_idx, coalesce(terms, '') AS terms FROM pairs LEFT JOIN j USING (conv_id, seg_idx)""")
def injected_entries(spark, d):
    own = jobs.records(spark, d).selectExpr("conv_id", "seg_idx", "array('t' || (conv_id % 9 + 1), 't99', 't' || (seg_idx % 5 + 1)) AS entry_ids")
    return records.with_entries(own, derived.glossary(spark), "conv_id", "seg_idx").select("conv_id", "seg_idx", F.array_join("terms", ",").alias("terms"))


@query("WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS term FROM documents) SELECT term, count(*) AS n FROM w WHERE source = 'src1' AND doc_id % 3 = 0 AND contains(lower(term), 'an') GROUP BY term")
def findings_grid(spark, d):
    w = _docs(spark, d).select(F.col("source").alias("status"), (F.col("doc_id") % 3 == 0).alias("conflict"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("term"))
    return records.grid(w, status="src1", conflict=True, contains="AN", column="term").groupBy("term").agg(F.count("*").alias("n"))


_MESSAGE = "CASE doc_id % 6 WHEN 0 THEN 'HTTP 429 for ' WHEN 1 THEN 'RESOURCE_EXHAUSTED ' WHEN 2 THEN 'a Rate Limit of ' ELSE '' END || text"


@query(rf"SELECT doc_id, regexp_matches({_MESSAGE}, '429|RESOURCE_EXHAUSTED') OR contains(lower({_MESSAGE}), 'rate limit') AS limited, trim(substring(text, 10, 12), ' ' || chr(10)) <> '' AS held FROM documents")
def message_tests(spark, d):
    needle = F.regexp_replace(F.substring("text", 10, 12), " ", "  ")
    return _docs(spark, d).select("doc_id", records.rate_limited(F.expr(_MESSAGE)).alias("limited"), records.holds(F.translate(needle, "aeiou", "AEIOU"), F.col("text")).alias("held"))


@query(f"WITH {_SEG} SELECT doc_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM seg WHERE seg_idx >= 3 AND seg_idx < 12 GROUP BY doc_id")
def corpus_slice(spark, d):
    return _segments(spark, d).filter("seg_idx >= 3 AND seg_idx < 12").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_STATE = f"""{_RF}, n AS (SELECT conv_id, count(*) AS segment_count, count(*) FILTER (WHERE from_tm) AS tm_reused FROM rec GROUP BY conv_id), f AS (SELECT conv_id, count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'actionable') AS actionable,
count(*) FILTER (WHERE severity = 'informational') AS informational, count(*) FILTER (WHERE NOT resolved AND {_SEVERE}) AS unresolved FROM fd GROUP BY conv_id),
st AS (SELECT conv_id, segment_count, tm_reused, coalesce(blocking, 0) AS blocking, coalesce(actionable, 0) AS actionable, coalesce(informational, 0) AS informational, coalesce(unresolved, 0) AS unresolved FROM n LEFT JOIN f USING (conv_id))"""


@query(f"""{_STATE}, v AS (SELECT conv_id, unnest([CASE WHEN conv_id % 7 = 0 THEN 'segment_count_differs' END, CASE WHEN conv_id % 5 = 0 AND blocking <> 0 THEN 'blocking_differs' END, CASE WHEN conv_id % 11 = 0 THEN 'unresolved_differs' END, CASE WHEN conv_id % 13 = 0 THEN 'unknown_delivery_status' END]) AS problem FROM st) SELECT * FROM v WHERE problem IS NOT NULL""")
def manifest_violations(spark, d):
    zero = ("blocking", "actionable", "informational", "unresolved")
    found = jobs.findings(spark, d)
    per = delivery.stats(found, "conv_id", open_only=False).join(delivery.unresolved(found).groupBy("conv_id").agg(F.count("*").alias("unresolved")), "conv_id", "left")
    state = jobs.records(spark, d).groupBy("conv_id").agg(F.count("*").alias("segment_count"), F.count_if("from_tm").alias("tm_reused")).join(per, "conv_id", "left").fillna(dict.fromkeys(zero, 0))
    wrong = state.withColumn("segment_count", F.col("segment_count") + F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0)).withColumn("blocking", F.when(F.col("conv_id") % 5 == 0, 0).otherwise(F.col("blocking")))
    wrong = wrong.withColumn("unresolved", F.col("unresolved") + F.when(F.col("conv_id") % 11 == 0, 2).otherwise(0)).withColumn("delivery_status", F.when(F.col("conv_id") % 13 == 0, "shipped").otherwise("final"))
    return records.manifest_violations(wrong, state)


@query(f"""WITH {_PAIRS} SELECT conv_id, seg_idx, unnest(CASE WHEN conv_id % 13 = 0 THEN ['invalid_json'] WHEN conv_id % 5 = 0 THEN ['missing_reviewed', 'missing_findings'] ELSE [] END) AS problem FROM pairs""")
def jsonl_violations(spark, d):
    whole = [F.concat_ws("-", "conv_id", "seg_idx").alias("segment_id"), "source", "target", F.col("reviewed"), "from_tm", F.array(F.lit("t1")).alias("glossary_entry_ids"), F.array(F.lit("f")).alias("findings"), F.lit("draft").alias("delivery_status")]
    some = [c for c, k in zip(whole, LINE_KEYS, strict=True) if k not in ("reviewed", "findings")]
    line = F.when(F.col("conv_id") % 13 == 0, F.concat(F.lit("{"), F.substring("source", 1, 5))).when(F.col("conv_id") % 5 == 0, F.to_json(F.struct(*some))).otherwise(F.to_json(F.struct(*whole)))
    return records.line_violations(jobs.records(spark, d).select("conv_id", "seg_idx", line.alias("line")), "conv_id", "seg_idx")


_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TRUSTED = f"(SELECT conv_id, seg_idx, source, target, from_tm FROM rec WHERE reviewed AND NOT stale AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.conv_id = rec.conv_id AND fd.seg_idx = rec.seg_idx AND {_SEVERE} AND (NOT resolved OR action IN ('accepted_risk', 'human_fixed'))))"


@query(f"""{_RF} SELECT conv_id, seg_idx, '<tu segid="' || conv_id || '-' || seg_idx || '"><prop type="from_tm">' || from_tm || '</prop><tuv xml:lang="en"><seg>' || {_ESC('source')} || '</seg></tuv><tuv xml:lang="zh-CN"><seg>' || {_ESC('target')} || '</seg></tuv></tu>' AS tu FROM {_TRUSTED}""")
def tmx_units(spark, d):
    return records.tmx_units(delivery.trusted(jobs.records(spark, d), jobs.findings(spark, d))).select("conv_id", "seg_idx", "tu")


@query(f"{_RF} SELECT conv_id, seg_idx, 'not_2_tuv' AS problem FROM {_TRUSTED} WHERE conv_id % 3 = 0")
def tmx_violations(spark, d):
    units = records.tmx_units(delivery.trusted(jobs.records(spark, d), jobs.findings(spark, d)))
    broken = F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("tu", '(?s)<tuv xml:lang="zh-CN">.*?</tuv>', "")).otherwise(F.col("tu"))
    return records.xml_violations(units.withColumn("tu", broken), "tu", "conv_id", "seg_idx", parts={"/tu/tuv": 2}, some="//seg")


_WORD_ENTRIES = """en AS (SELECT 't-' || lower(term) AS id, min(term) AS source, 'R-' || min(term) AS preferred, CASE WHEN count(*) % 3 = 0 THEN ['<' || min(term) || '>', 'no'] ELSE [] END AS forbidden, CASE WHEN count(*) % 4 = 0 THEN 'preserve' ELSE 'translate' END AS behavior, CASE WHEN count(*) > 5 THEN 'locked' ELSE 'provisional' END AS status
FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][A-Za-z]{5,}')) AS term FROM documents) GROUP BY lower(term))"""


def _entries(spark, d):
    w = _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]{5,}"), F.lit(0))).alias("term"))
    n = w.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("source"), F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    return n.select(
        F.concat(F.lit("t-"), "k").alias("id"), "source", F.concat(F.lit("R-"), "source").alias("preferred"), F.when(F.col("n") % 3 == 0, F.array(F.concat(F.lit("<"), "source", F.lit(">")), F.lit("no"))).otherwise(none).alias("forbidden"),
        F.when(F.col("n") % 4 == 0, "preserve").otherwise("translate").alias("behavior"), F.when(F.col("n") > 5, "locked").otherwise("provisional").alias("status"),
    )


@query(f"""WITH {_WORD_ENTRIES} SELECT id, '<termEntry id="' || id || '"><langSet xml:lang="en"><tig><term>' || source || '</term></tig></langSet><langSet xml:lang="zh-CN">' || CASE WHEN behavior = 'preserve' THEN '<tig><term>' || source || '</term><termNote type="behavior">preserve</termNote></tig>'
ELSE '<tig><term>' || preferred || '</term><termNote type="termStatus">' || status || '</termNote></tig>' || array_to_string(list_transform(forbidden, lambda x: '<ntig><termGrp><term>' || {_ESC('x')} || '</term><termNote type="termStatus">prohibited</termNote></termGrp></ntig>'), '') END || '</langSet></termEntry>' AS entry FROM en""")
def tbx_entries(spark, d):
    return records.tbx_entries(_entries(spark, d)).select("id", "entry")


@query(f"WITH {_WORD_ENTRIES} SELECT id, 'not_2_langSet' AS problem FROM en WHERE length(id) % 5 = 0 UNION ALL SELECT id, 'no_term' FROM en WHERE length(id) % 5 = 0")
def tbx_violations(spark, d):
    own = records.tbx_entries(_entries(spark, d))
    broken = F.when(F.length("id") % 5 == 0, F.lit("<termEntry><langSet/></termEntry>")).otherwise(F.col("entry"))
    return records.xml_violations(own.withColumn("entry", broken), "entry", "id", parts={"/termEntry/langSet": 2}, some="//term")


_STATS = """'{"total": ' || doc_id || ', "by": {"src": "' || source || '", "n": ' || (doc_id * 1000) || '}}'"""
_PATH = "CASE doc_id % 4 WHEN 0 THEN 'total' WHEN 1 THEN 'by.src' WHEN 2 THEN 'by.n' ELSE 'by.none' END"
_SHOWN = "CASE WHEN doc_id % 8 = 2 THEN CAST(doc_id AS STRING) || ',000' WHEN doc_id % 8 = 6 THEN CAST(doc_id AS STRING) || '000' ELSE 'src1' END"


@query(f"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN source WHEN 2 THEN (doc_id * 1000)::VARCHAR END AS value, {_SHOWN} AS shown FROM documents) SELECT doc_id, value, CASE WHEN value IS NULL THEN 'unknown_project_statistic' WHEN replace(shown, ',', '') <> value THEN 'wrong_project_statistic' ELSE 'right' END AS verdict FROM s""")
def statistic_values(spark, d):
    own = _docs(spark, d).selectExpr("doc_id", f"{_STATS} AS stats", f"{_PATH} AS path", f"{_SHOWN} AS shown").withColumn("value", records.statistic(F.col("stats"), F.col("path")))
    verdict = F.when(F.col("value").isNull(), "unknown_project_statistic").when(~records.renders(F.col("shown"), F.col("value")), "wrong_project_statistic").otherwise("right")
    return own.select("doc_id", "value", verdict.alias("verdict"))


@query(f"WITH {_SEG} SELECT doc_id, seg_idx, CASE seg_idx % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS held FROM seg WHERE length(text) >= 60 AND seg_idx % 3 <> 1 UNION ALL SELECT doc_id, seg_idx, position(substring(text, 2, 10) IN substring(text, position(substring(text, 31, 10) IN text) + 10)) > 0 FROM seg WHERE length(text) >= 60 AND seg_idx % 3 = 1 AND NOT regexp_matches(text, '\\s\\s|^\\s|\\.\\.\\.|…') AND NOT starts_with(substring(text, 2, 10), ' ') AND NOT ends_with(substring(text, 31, 10), ' ') AND NOT starts_with(substring(text, 31, 10), ' ') AND NOT ends_with(substring(text, 2, 10), ' ')")
def described_pieces(spark, d):
    segs = _segments(spark, d).filter(F.length("text") >= 60)
    word = lambda a, n: F.substring("text", a, n)
    clean = ~F.col("text").rlike(r"\s\s|^\s|\.\.\.|…") & ~word(2, 10).startswith(" ") & ~word(2, 10).endswith(" ") & ~word(31, 10).startswith(" ") & ~word(31, 10).endswith(" ")
    forward = F.concat(word(2, 10), F.lit("..."), word(31, 10))
    piece = F.when(F.col("seg_idx") % 3 == 1, F.concat(word(31, 10), F.lit("…"), word(2, 10))).otherwise(F.when(clean, forward).otherwise(F.col("text")))
    own = segs.filter((F.col("seg_idx") % 3 != 1) | clean)
    return own.select("doc_id", "seg_idx", records.described(piece, F.col("text")).alias("held"))


@query(f"""WITH {_SEG}, m AS (SELECT doc_id, 's' || seg_idx AS section_id, text FROM seg WHERE NOT starts_with(text, '## ')) SELECT doc_id, section_id, md5(trim(text, ' ')) AS body_hash FROM m""")
def markdown_sections(spark, d):
    segs = _segments(spark, d).filter("NOT startswith(text, '## ')")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: F.concat(F.lit("## s"), x["seg_idx"], F.lit(". Title\n"), x["text"]))
    reports_ = segs.groupBy("doc_id").agg(F.concat(F.lit("# Report\n"), F.array_join(lines, "\n")).alias("body"))
    return records.markdown_sections(reports_).select("doc_id", "section_id", F.md5("body").alias("body_hash"))


@query(r"""WITH t AS (SELECT doc_id, text, position('que' IN lower(text)) AS p FROM documents), s AS (SELECT doc_id, text, p, substring(text, 1, p - 1) AS a, substring(text, p + 3) AS b FROM t WHERE p > 0)
SELECT doc_id, md5(trim(substring(a, length(regexp_extract(a, '(?s)^.*[.!?]["''”’]?\s+')) + 1) || substring(text, p, 3) || CASE WHEN regexp_matches(b, '(?s)[.!?]["''”’]?(?:\s|$)') THEN regexp_extract(b, '(?s)^.*?[.!?]["''”’]?(?:\s|$)') ELSE b END, ' ' || chr(10))) AS passage_hash FROM s""")
def trigger_passages(spark, d):
    own = _docs(spark, d).withColumn("p", records.passage(F.col("text"), F.lit("QUE"))).filter("p IS NOT NULL")
    return own.select("doc_id", F.md5(F.trim(F.regexp_replace("p", r"^[ \n]+|[ \n]+$", ""))).alias("passage_hash"))


_HAN = "CASE conv_id % 4 WHEN 0 THEN ' 翻译目的论' WHEN 1 THEN ' 目的' WHEN 2 THEN ' www.翻译目的.com 论文' ELSE '' END"


@query(f"""WITH {_PAIRS}, h AS (SELECT conv_id, seg_idx, source || ' 研究翻译目的论 论文' AS source, target || {_HAN} AS target FROM pairs), r AS (SELECT conv_id, seg_idx, source, unnest(regexp_extract_all(regexp_replace(target, 'www\\.\\S+', ' ', 'g'), '[一-鿿]{{2,}}')) AS run FROM h)
SELECT conv_id, seg_idx, run, CASE WHEN length(run) >= 4 THEN 'actionable' ELSE 'informational' END AS severity FROM r WHERE contains(source, run)""")
def han_residuals(spark, d):
    own = jobs.records(spark, d).selectExpr("conv_id", "seg_idx", "source || ' 研究翻译目的论 论文' AS source", f"target || {_HAN} AS target")
    return records.han_residuals(own, "conv_id", "seg_idx")


@query(f"""WITH {_SEG}, c AS (SELECT doc_id, seg_idx AS case_id, (doc_id + seg_idx) % 6 = 0 AS linked, CASE WHEN seg_idx / greatest(max(seg_idx) OVER (PARTITION BY doc_id), 1) < 1 / 3 THEN 1 WHEN seg_idx / greatest(max(seg_idx) OVER (PARTITION BY doc_id), 1) < 2 / 3 THEN 2 ELSE 3 END AS zone, seg_idx AS pos FROM seg),
r AS (SELECT *, CASE WHEN linked THEN 0 WHEN row_number() OVER (PARTITION BY doc_id, zone ORDER BY pos) = 1 THEN zone ELSE 9 END AS rank FROM c) SELECT doc_id, case_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rank, pos))::INT AS n, linked FROM r QUALIFY n <= 3""")
def academic_case_selection(spark, d):
    own = _segments(spark, d).select("doc_id", F.col("seg_idx").alias("case_id"), ((F.col("doc_id") + F.col("seg_idx")) % 6 == 0).alias("linked"), cases.zone("seg_idx", "doc_id").alias("zone"), F.col("seg_idx").alias("pos"))
    return records.choose_cases(own)


@query("WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) AS term FROM documents) SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, min(doc_id * 100000 + length(term)), term LIMIT 20")
def tm_top_conflicts(spark, d):
    w = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("t")).select("doc_id", F.lower("t").alias("term"))
    return records.top_conflicts(w.select("term", F.struct(F.col("doc_id") * 100000 + F.length("term"), "term").alias("pos")))


@query(f"""WITH RECURSIVE {_SEG}, s AS (SELECT doc_id, seg_idx, length(text) AS n FROM seg), b AS (SELECT doc_id, seg_idx, n AS size, 0 AS batch FROM s WHERE seg_idx = 0
UNION ALL SELECT s.doc_id, s.seg_idx, CASE WHEN size + s.n > 2600 THEN s.n ELSE size + s.n END, CASE WHEN size + s.n > 2600 THEN batch + 1 ELSE batch END FROM b JOIN s ON s.doc_id = b.doc_id AND s.seg_idx = b.seg_idx + 1) SELECT doc_id, seg_idx, batch FROM b""")
def greedy_chunks(spark, d):
    return sequence.pack(_segments(spark, d), most=1 << 30, chars=2600)


@query(f"WITH {FINDING_SQL}, o AS (SELECT conv_id, event_id, seg_idx, (event_id // 100) * 8 AS off FROM fd) SELECT event_id, conv_id, off + seg_idx AS segment_index FROM o")
def global_findings(spark, d):
    return jobs.findings(spark, d).selectExpr("event_id", "conv_id", "CAST(floor(event_id / 100.0) AS BIGINT) * 8 + seg_idx AS segment_index")


@query("WITH o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS style, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS chars FROM documents) SELECT doc_id, coalesce(style, 'plain') AS style, coalesce(chars, 0) AS chars, false AS reviewed, 3 AS version FROM o")
def migrated_state(spark, d):
    old = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("style"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("chars"))
    return records.coalesced(old, {"style": "plain", "chars": 0, "reviewed": False}, 3)


def _spans(tokens):
    """Spans over words: a clause, a phrase or a word, by the word's place; the rarer kind has the lesser priority."""
    i = F.col("i")
    kinds = [F.when(i % 7 == 0, F.struct(i.alias("a"), (i + 4).alias("b"), F.lit("hard").alias("kind"), F.lit(2).alias("priority"))), F.when(i % 5 == 0, F.struct(i.alias("a"), (i + 2).alias("b"), F.lit("domain").alias("kind"), F.lit(1).alias("priority")))]
    kinds.append(F.when((i % 3 == 0) & (F.length("w") > 6), F.struct(i.alias("a"), (i + 1).alias("b"), F.lit("rare").alias("kind"), F.lit(0).alias("priority"))))
    return tokens.select("key", F.explode(F.array_compact(F.array(*kinds))).alias("s")).select("key", "s.*")


@query(f"""WITH {_SEG}, t AS (SELECT doc_id * 1000 + seg_idx AS key, unnest(range(len(x)))::INT AS i, unnest(x) AS w FROM (SELECT doc_id, seg_idx, string_split(text, ' ') AS x FROM seg)),
s AS (SELECT key, i AS a, i + 4 AS b, 'hard' AS kind, 2 AS priority FROM t WHERE i % 7 = 0 UNION ALL SELECT key, i, i + 2, 'domain', 1 FROM t WHERE i % 5 = 0 UNION ALL SELECT key, i, i + 1, 'rare', 0 FROM t WHERE i % 3 = 0 AND length(w) > 6),
x AS (SELECT key, a AS x FROM s UNION SELECT key, b FROM s), c AS (SELECT key, x, lead(x) OVER (PARTITION BY key ORDER BY x) AS y FROM x) SELECT c.key, x, y, arg_min(kind, priority) AS kind FROM c JOIN s ON s.key = c.key AND a <= x AND b >= y WHERE y IS NOT NULL GROUP BY c.key, x, y""")
def word_span_overlay(spark, d):
    tokens = _segments(spark, d).select((F.col("doc_id") * 1000 + F.col("seg_idx")).alias("key"), F.posexplode(F.split("text", " ")).alias("i", "w"))
    return sequence.overlay(_spans(tokens))


@query(f"""WITH RECURSIVE {_SEG}, s AS (SELECT doc_id, seg_idx, length(text) AS n, CAST(floor(seg_idx / 7.0) AS INT) AS unit FROM seg), b AS (SELECT doc_id, seg_idx, 1 AS cnt, n AS size, 0 AS batch, unit FROM s WHERE seg_idx = 0
UNION ALL SELECT s.doc_id, s.seg_idx, CASE WHEN cnt >= 4 OR size + s.n > 1600 OR s.unit <> b.unit THEN 1 ELSE cnt + 1 END, CASE WHEN cnt >= 4 OR size + s.n > 1600 OR s.unit <> b.unit THEN s.n ELSE size + s.n END, CASE WHEN cnt >= 4 OR size + s.n > 1600 OR s.unit <> b.unit THEN batch + 1 ELSE batch END, s.unit
FROM b JOIN s ON s.doc_id = b.doc_id AND s.seg_idx = b.seg_idx + 1) SELECT doc_id, seg_idx, batch FROM b""")
def unit_batches(spark, d):
    return sequence.pack(_segments(spark, d).withColumn("unit", F.floor(F.col("seg_idx") / 7).cast("int")), unit_col="unit")


@query(f"""WITH RECURSIVE {_SEG}, s AS (SELECT doc_id, seg_idx, length(text) AS n, right(text, 1) AS z FROM seg), b AS (SELECT doc_id, seg_idx, n AS size, z, 0 AS paragraph FROM s WHERE seg_idx = 0
UNION ALL SELECT s.doc_id, s.seg_idx, CASE WHEN NOT contains('.!?"”’…:;)', b.z) AND b.size > 40 THEN b.size + 1 + s.n ELSE s.n END, s.z, CASE WHEN NOT contains('.!?"”’…:;)', b.z) AND b.size > 40 THEN paragraph ELSE paragraph + 1 END FROM b JOIN s ON s.doc_id = b.doc_id AND s.seg_idx = b.seg_idx + 1) SELECT doc_id, seg_idx, paragraph FROM b""")
def unfinished_paragraphs(spark, d):
    return sequence.merge_unfinished(_segments(spark, d))


@query(f"WITH {_SEG} SELECT doc_id, seg_idx, md5(coalesce(string_agg(text, ' || ') OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS before, md5(coalesce(string_agg(text, ' || ') OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '')) AS after FROM seg")
def context_texts(spark, d):
    both = sequence.context_texts(_segments(spark, d))
    return both.select("doc_id", "seg_idx", *[F.md5(F.array_join(c, " || ")).alias(c) for c in ("before", "after")])


_ARM = "['A', 'B', 'C', 'D'][conv_id % 4 + 1]"


@query(f"""WITH {_PAIRS}, m AS (SELECT {_ARM} AS arm, count(*)::DOUBLE AS n_pairs, sum(length(target))::DOUBLE AS chars, round(avg(length(source)), 4) AS mean_source FROM pairs GROUP BY 1), l AS (UNPIVOT m ON n_pairs, chars, mean_source INTO NAME metric VALUE value),
c AS (SELECT unnest(['A', 'A', 'B', 'A']) AS a, unnest(['B', 'C', 'D', 'D']) AS b) SELECT c.a || '_to_' || c.b AS comparison, r.metric, x.value AS left_value, r.value AS right_value, round(r.value - x.value, 4) AS delta FROM c JOIN l r ON r.arm = c.b LEFT JOIN l x ON x.arm = c.a AND x.metric = r.metric""")
def arm_delta_table(spark, d):
    arm = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("conv_id") % 4 + 1).cast("int"))
    per = jobs.records(spark, d).withColumn("arm", arm).groupBy("arm").agg(F.count("*").alias("n_pairs"), F.sum(F.length("target")).alias("chars"), F.round(F.avg(F.length("source")), 4).alias("mean_source"))
    return qa.delta_table(per)


@query(f"WITH {_PAIRS}, {RECORD_SQL} SELECT arm, round(sum(coalesce(initial_target <> target, false)::INT) FILTER (WHERE NOT from_tm) / count(*) FILTER (WHERE NOT from_tm), 4) AS automatic_repair_rate FROM rec GROUP BY arm")
def repair_rates(spark, d):
    return qa.repair_rate(jobs.findings(spark, d), jobs.records(spark, d))


@query(f"WITH {_PAIRS}, {_G}, {_HITS}, a AS (SELECT arm, id, count(*) AS occurrences, round(sum(kept::INT) / count(*), 4) AS rate FROM hits WHERE status = 'locked' GROUP BY arm, id) SELECT *, CASE WHEN rate < 0.9 THEN 'low adoption' WHEN rate < 1 THEN 'not always adopted' ELSE '' END AS note FROM a")
def term_audit_notes(spark, d):
    jobs_pairs = jobs.records(spark, d).select("conv_id", "seg_idx", "arm", "source", "target")
    return qa.adoption_notes(terms.adoption(jobs_pairs, _named(spark), "arm")).select("arm", "id", "occurrences", "rate", "note")


_STYLE = {"recommended": "CASE doc_id % 4 WHEN 0 THEN 'literary' WHEN 1 THEN 'technical' WHEN 2 THEN 'baroque' END", "confidence": "CASE doc_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '7' ELSE 'high' END"}


@query(f"""WITH s AS (SELECT doc_id, {_sql(_STYLE)}, list_slice(list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> ''), 1, 4) AS r FROM documents), n AS (SELECT doc_id, CASE WHEN recommended IN ('literary', 'technical') THEN recommended ELSE 'general' END AS recommended,
least(greatest(coalesce(try_cast(confidence AS DOUBLE), 0), 0), 1)::DOUBLE AS confidence, array_to_string(r, ',') AS reasons FROM s) SELECT *, substring(sha256(concat_ws('|', recommended, reasons, '')), 1, 12) AS style_id FROM n""")
def style_recommendations(spark, d):
    own = _of(_docs(spark, d), _STYLE, "doc_id", "text").withColumn("reasons", F.split("text", " ")).withColumn("domains", F.lit(None).cast("array<string>"))
    return records.style(own, known=("general", "literary", "technical")).select("doc_id", "recommended", "confidence", F.array_join("reasons", ",").alias("reasons"), "style_id")


_CHAPTER = {"pos": "seg_idx + 1", "section_id": "CASE WHEN seg_idx % 3 = 0 THEN ' ' ELSE 'c' || seg_idx END", "title": "CASE WHEN seg_idx % 4 = 0 THEN '' ELSE ' Title ' || seg_idx END"}


@query(f"""WITH {_SEG}, c AS (SELECT doc_id, {_sql(_CHAPTER)}, seg_idx FROM seg), n AS (SELECT doc_id AS report_id, pos, CASE WHEN trim(section_id, ' ') = '' THEN pos::VARCHAR ELSE section_id END AS section_id, trim(title, ' ') AS title, seg_idx FROM c)
SELECT report_id, pos, section_id, CASE WHEN title = '' THEN 'Section ' || section_id ELSE title END AS title, CASE WHEN seg_idx % 2 = 0 THEN '### 1.1 Aim' ELSE '' END || CASE WHEN seg_idx % 5 = 0 THEN '#### 1.2 End' ELSE '' END AS headings FROM n""")
def chapter_constraints(spark, d):
    sub = lambda on, i, t, n: F.when(on, F.struct(F.lit(i).alias("heading_id"), F.lit(t).alias("title"), F.lit(n).cast("int").alias("level")))
    k = F.col("seg_idx")
    made = F.array_compact(F.array(sub(k % 2 == 0, " 1.1", "Aim ", None), sub(k % 2 == 1, "1.9", " ", 2), sub(k % 5 == 0, "1.2", "End", 3)))
    rows = _segments(spark, d).selectExpr("doc_id AS report_id", "seg_idx", *[f"{x} AS {n}" for n, x in _CHAPTER.items()]).withColumn("subsections", made)
    heads = F.array_join(F.transform("subsections", lambda x: F.concat(x["mark"], F.lit(" "), x["heading_id"], F.lit(" "), x["title"])), "")
    return records.chapters(rows).select("report_id", "pos", "section_id", "title", heads.alias("headings"))
