"""Queries over what reviewers ask for; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import tools
from glossweave.plans.catalogue import _G, _SEG, _docs, _match, _segments, query
from glossweave.sources import derived

#: Requests that documents make: tool, arguments as JSON, and for the SQL what the arguments are read as.
_ASKS = [
    ("get_segment", '{"segment_id": 3}', {"segment_id": 3}), ("get_segment", '{"segment_id": "2"}', {"segment_id": 2}), ("get_segment", '{"segment_id": 99999}', {"segment_id": 99999}), ("get_neighbors", '{"segment_id": 1, "before": 9, "after": 2}', {"segment_id": 1, "a": 5, "b": 2}),
    ("get_neighbors", '{"segment_id": 4}', {"segment_id": 4, "a": 3, "b": 3}), ("find_occurrences", '{"source_expression": "the"}', {"expression": "the", "sel": ["first", "middle", "last"]}), ("find_occurrences", '{"source": "LE", "selectors": ["last"]}', {"expression": "LE", "sel": ["last"]}),
    ("get_term", '{"source": "THE"}', {"term_source": "THE"}), ("get_term", '{"term_id": "t5"}', {"term_id": "t5"}), ("get_document_profile", "{}", {}), ("get_document_synopsis", "{}", {}), ("get_section_digest", '{"segment_id": 7}', {"segment_id": 7}), ("get_section_digest", '{"section_id": "s1"}', {"section_id": "s1"}),
    ("get_translation_history", '{"segment_id": 1}', {"segment_id": 1}), ("get_findings", "{}", {}), ("get_findings", '{"segment_id": 2}', {"segment_id": 2}), ("get_everything", "{}", {}), ("get_neighbors", '{"segment_id": 9, "before": "many"}', {"segment_id": 9}),
]
_N = len(_ASKS)
#: Seven requests a document, of which five count; the fourth is the first again.
_WHICH = [f"(doc_id * 5 + {k * 4 if k != 3 else 0}) % {_N}" for k in range(7)]
# Of a document's segments what a reviewer may see.
_PAIR = {
    "target": "'T ' || text", "initial_target": "CASE WHEN seg_idx % 3 = 0 THEN text ELSE '' END", "accepted_target": "CASE WHEN seg_idx % 4 = 0 THEN 'A ' || text ELSE '' END", "candidate": "CASE WHEN seg_idx % 2 = 0 THEN 'C ' || text ELSE '' END",
    "target_provenance": "CASE WHEN seg_idx % 5 = 0 THEN 'human' ELSE 'generated' END", "reviewed": "seg_idx % 2 = 0", "from_tm": "seg_idx % 5 = 1",
}
_BLIND = "doc_id % 3 = 0"


def _inputs(spark, d):
    docs, segs = _docs(spark, d), _segments(spark, d)
    one = F.array(*[F.lit(f'{{"tool": "{tool}", "arguments": {args}}}') for tool, args, _ in _ASKS])
    several = F.array_join(F.array(*[F.get(one, F.expr(x).cast("int")) for x in _WHICH]), ", ")
    payload = F.when(F.col("doc_id") % 41 == 3, "no object").otherwise(F.concat(F.lit('```json\n{"findings": [], "evidence_requests": ['), several, F.lit("]}\n```")))
    payloads = docs.select(F.col("doc_id").alias("job"), F.lit(0).alias("round"), payload.alias("payload"), F.expr(_BLIND).alias("blind"))
    own = segs.selectExpr("doc_id AS job", "seg_idx", "text", *[f"{x} AS {name}" for name, x in _PAIR.items()])
    entries = derived.glossary(spark).select("id", "source", F.to_json(F.struct("id", "source", "preferred", "status")).alias("entry"), "pos")
    profiles = docs.select(F.col("doc_id").alias("job"), F.to_json(F.struct(F.col("lang").alias("language"), F.col("source").alias("origin"))).alias("profile"), F.to_json(F.struct(F.substring("text", 1, 60).alias("summary"))).alias("synopsis"))
    digests = derived.sections(segs).withColumn("pos", F.col("start_segment"))
    digests = digests.select(F.col("doc_id").alias("job"), F.col("section_id").alias("unit_id"), "start_segment", "end_segment", F.to_json(F.struct(F.col("section_id").alias("unit_id"), "start_segment", "end_segment")).alias("digest"), "pos")
    found = segs.filter("length(text) > 200").select(F.col("doc_id").alias("job"), "seg_idx", F.to_json(F.struct(F.col("seg_idx").alias("segment_id"), F.lit("long").alias("type"), F.length("text").alias("n"))).alias("finding"), F.col("seg_idx").alias("pos"))
    return payloads, own, entries, profiles, digests, found


def _column(name: str, kind: str) -> str:
    values = ", ".join("NULL" if name not in read else repr(read[name]) for *_, read in _ASKS)
    return f"([{values}]::{kind}[])[w + 1]"


def _fields(*names: str) -> str:
    return ", ".join(f"'{name}', {x}" for name, x in (n if isinstance(n, tuple) else (n, n) for n in names))


_SEEN = _fields(("segment_id", "seg_idx"), ("source", "text"), ("target", "CASE WHEN candidate <> '' THEN candidate ELSE accepted_target END"))
_WHOLE = _fields(("segment_id", "seg_idx"), ("source", "text"), "target", "initial_target", "accepted_target", "target_provenance", "reviewed", "from_tm")
_PAST = _fields(("segment_id", "seg_idx"), ("source", "text"), "initial_target", "target", "accepted_target", "target_provenance", "reviewed", "from_tm")
_TOOLS_SQL = f"""WITH {_SEG}, {_G}, sg AS (SELECT doc_id AS job, seg_idx, text, {", ".join(f"{x} AS {name}" for name, x in _PAIR.items())}, max(seg_idx) OVER (PARTITION BY doc_id) AS last FROM seg),
rq AS (SELECT doc_id AS job, {_BLIND} AS blind, unnest([1, 2, 3, 4, 5]) AS pos, unnest([{", ".join(_WHICH[:5])}]) AS w FROM documents WHERE doc_id % 41 <> 3),
dq AS (SELECT job, any_value(blind) AS blind, w, min(pos) AS first FROM rq GROUP BY job, w),
nq AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY first) AS n, {repr([t for t, *_ in _ASKS])}[w + 1] AS tool, {", ".join(f"{_column(name, kind)} AS {name}" for name, kind in {"segment_id": "BIGINT", "a": "INT", "b": "INT", "expression": "VARCHAR", "sel": "VARCHAR[]", "term_source": "VARCHAR", "term_id": "VARCHAR", "section_id": "VARCHAR"}.items())} FROM dq),
oc AS (SELECT nq.job, n, list(seg_idx ORDER BY seg_idx) AS l FROM nq JOIN sg ON sg.job = nq.job AND {_match("expression", "text")} WHERE tool = 'find_occurrences' GROUP BY nq.job, n),
pt AS (SELECT nq.job, n, tool, blind, seg_idx FROM nq JOIN sg ON sg.job = nq.job AND tool IN ('get_segment', 'get_translation_history') AND seg_idx = segment_id
  UNION ALL SELECT nq.job, n, tool, blind, seg_idx FROM nq JOIN sg ON sg.job = nq.job AND tool = 'get_neighbors' AND segment_id <= last AND seg_idx BETWEEN segment_id - a AND segment_id + b AND seg_idx <> segment_id
  UNION SELECT nq.job, n, tool, blind, unnest(list_filter([CASE WHEN list_contains(sel, 'first') THEN l[1] END, CASE WHEN list_contains(sel, 'middle') THEN l[len(l) // 2 + 1] END, CASE WHEN list_contains(sel, 'last') THEN l[len(l)] END], lambda x: x IS NOT NULL)) FROM nq JOIN oc USING (job, n)),
px AS (SELECT job, n, string_agg(CASE WHEN blind THEN json_object({_SEEN}) WHEN tool = 'get_translation_history' THEN json_object({_PAST}) ELSE json_object({_WHOLE}) END::VARCHAR, ',' ORDER BY seg_idx) AS parts FROM pt JOIN sg USING (job, seg_idx) GROUP BY job, n),
tm AS (SELECT job, n, arg_min(json_object('id', id, 'source', source, 'preferred', preferred, 'status', status)::VARCHAR, pos) AS r FROM nq JOIN g ON tool = 'get_term' AND (term_id = id OR lower(term_source) = lower(source)) GROUP BY ALL),
sd AS (SELECT nq.job, n, arg_min(json_object('unit_id', 's' || k, 'start_segment', k * 10, 'end_segment', k * 10 + 9)::VARCHAR, k) AS r FROM nq JOIN (SELECT DISTINCT job, last FROM sg) z ON z.job = nq.job, range(1000) t(k)
  WHERE tool = 'get_section_digest' AND k <= last // 10 AND (section_id = 's' || k OR segment_id BETWEEN k * 10 AND k * 10 + 9) GROUP BY ALL),
fi AS (SELECT nq.job, n, '[' || string_agg(json_object('segment_id', seg_idx, 'type', 'long', 'n', length(text))::VARCHAR, ',' ORDER BY seg_idx) || ']' AS r FROM nq JOIN sg ON sg.job = nq.job AND length(text) > 200 AND (segment_id IS NULL OR segment_id = seg_idx) WHERE tool = 'get_findings' AND NOT blind GROUP BY ALL),
an AS (SELECT nq.*, coalesce(CASE WHEN tool IN ('get_neighbors', 'find_occurrences') THEN '[' || parts || ']' ELSE parts END, tm.r, sd.r, fi.r, CASE tool WHEN 'get_document_profile' THEN json_object('language', lang, 'origin', source)::VARCHAR WHEN 'get_document_synopsis' THEN json_object('summary', substring(text, 1, 60))::VARCHAR
  WHEN 'get_everything' THEN '{{"error":"unknown tool get_everything"}}' WHEN 'get_neighbors' THEN '[]' WHEN 'find_occurrences' THEN '[]' WHEN 'get_findings' THEN '[]' ELSE '{{}}' END) AS result
  FROM nq JOIN documents ON doc_id = nq.job LEFT JOIN px ON px.job = nq.job AND px.n = nq.n LEFT JOIN tm ON tm.job = nq.job AND tm.n = nq.n LEFT JOIN sd ON sd.job = nq.job AND sd.n = nq.n LEFT JOIN fi ON fi.job = nq.job AND fi.n = nq.n),
aw AS (SELECT job, 'E' || n AS evidence_id, n, w, tool, blind, CASE WHEN strlen(result) > {tools.MAX_BYTES} THEN '{{"error":"evidence is too large","payload_bytes":' || strlen(result) || ',"max_bytes":{tools.MAX_BYTES}}}' ELSE result END AS result FROM an
  UNION ALL SELECT doc_id, 'E1', 1, NULL, NULL, {_BLIND}, '{{"error":"malformed payload"}}' FROM documents WHERE doc_id % 41 = 3)"""


@query(f"{_TOOLS_SQL} SELECT job, evidence_id, tool, blind, md5(result) AS result_hash, strlen(result) AS n_bytes FROM aw")
def evidence_answers(spark, d):
    (payloads, *rest), deal = _inputs(spark, d), derived.dealt_by(derived.table(spark, d, "documents"))
    found = tools.answered(tools.asked(payloads, deal=deal), *rest, deal=deal)
    return found.select("job", "evidence_id", "tool", "blind", F.md5("result").alias("result_hash"), F.octet_length("result").cast("long").alias("n_bytes"))


@query(f"{_TOOLS_SQL} SELECT job, pos, evidence_id, aw.tool, pos > first AS deduped, false AS failed, contains(result, 'too large') AS withheld FROM rq JOIN dq USING (job, w) JOIN aw USING (job, w) UNION ALL SELECT job, 0, evidence_id, tool, false, true, false FROM aw WHERE w IS NULL")
def evidence_trace(spark, d):
    (payloads, *rest), deal = _inputs(spark, d), derived.dealt_by(derived.table(spark, d, "documents"))
    asked = tools.asked(payloads, deal=deal)
    return tools.trace(asked, tools.answered(asked, *rest, deal=deal), deal=deal).select("job", "pos", "evidence_id", "tool", "deduped", "failed", F.contains("result", F.lit("too large")).alias("withheld"))
