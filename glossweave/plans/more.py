"""Queries over versions, units, cases, reports and model answers; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.functions.python import delta, find_span, meaningful_revision, similarity
from glossweave.operators import versions
from glossweave.plans.catalogue import _PAIRS, _SEG, _WITH_F, _docs, _findings, _pairs, _segments, query
from glossweave.sources.derived import dealt, table


@query("""WITH s AS (SELECT user_id AS job, event_id AS n, sha256(event_type) AS glossary_hash FROM events), c AS (SELECT *, lag(glossary_hash) OVER (PARTITION BY job ORDER BY n) AS before FROM s)
SELECT job, row_number() OVER (PARTITION BY job ORDER BY n) AS version, n, glossary_hash FROM c WHERE before IS NULL OR before <> glossary_hash""")
def glossary_freeze_versions(spark, d):
    # every event of a user freezes the glossary that its type stands for
    return versions.freeze(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("n"), F.sha2("event_type", 256).alias("glossary_hash")))


_VERSIONS = [("h1", 1, "t1", "le", "het", 0), ("h1", 1, "t1", "le", "den", 1), ("h1", 1, "t2", "of", "van", 2), ("h2", 2, "t1", "Le", "die", 0), ("h2", 2, "t3", "ouen", "the", 1)]


@query(f"""WITH {_PAIRS}, p AS (SELECT conv_id, seg_idx, 'h' || (conv_id % 3) AS hash_used, 't' || (seg_idx % 3 + 1) AS entry_id FROM pairs),
e AS (SELECT * FROM (VALUES {", ".join(map(str, _VERSIONS))}) v(glossary_hash, version, id, source, preferred, pos)),
l AS (SELECT glossary_hash, id, arg_max(source, pos) AS source, arg_max(preferred, pos) AS used FROM e GROUP BY ALL),
w AS (SELECT lower(source) AS k, arg_max(preferred, version * 100 + pos) AS now FROM e GROUP BY 1)
SELECT conv_id, seg_idx, entry_id, used, now, used IS DISTINCT FROM now AS changed FROM p LEFT JOIN l ON glossary_hash = hash_used AND id = entry_id LEFT JOIN w ON k = lower(source)""")
def glossary_version_lookup(spark, d):
    p = _pairs(spark, d).select("conv_id", "seg_idx", F.concat(F.lit("h"), F.col("conv_id") % 3).alias("hash_used"), F.concat(F.lit("t"), F.col("seg_idx") % 3 + 1).alias("entry_id"))
    return versions.entry_used(p, spark.createDataFrame(_VERSIONS, "glossary_hash string, version int, id string, source string, preferred string, pos int"))


_OBS = r"o AS (SELECT lower(regexp_extract(source, '[A-Za-z]+')) AS source, lower(regexp_extract(target, '[A-Za-z]+')) AS target, conv_id * 1000 + seg_idx AS seg FROM pairs WHERE regexp_matches(source, '[A-Za-z]'))"


@query(f"WITH {_PAIRS}, {_OBS} SELECT source, count(DISTINCT target) AS n_targets, count(*) AS n, min(seg) AS first_seg, arg_min(target, seg) AS target, CASE WHEN count(DISTINCT target) > 1 THEN 'target_conflict' WHEN count(*) > 1 THEN 'known_consistency' ELSE 'emergent_candidate' END AS kind FROM o GROUP BY source")
def knowledge_observations(spark, d):
    word = lambda c: F.lower(F.regexp_extract(c, "[A-Za-z]+", 0))
    o = _pairs(spark, d).filter(F.col("source").rlike("[A-Za-z]")).select(word("source").alias("source"), word("target").alias("target"), (F.col("conv_id") * 1000 + F.col("seg_idx")).alias("seg"))
    return versions.observe(o)


@query(f"""WITH {_SEG}, s AS (SELECT DISTINCT doc_id, unnest(['a', 'b', 'c']) AS section_id, unnest([1, 3, 8]) AS start_segment, unnest([3, 5, 11]) AS end_segment FROM seg),
h AS (SELECT g.doc_id, seg_idx, arg_min(section_id, start_segment) AS section_id FROM seg g LEFT JOIN s ON s.doc_id = g.doc_id AND seg_idx BETWEEN start_segment AND end_segment GROUP BY ALL),
m AS (SELECT *, CASE WHEN seg_idx > 0 AND section_id IS NOT DISTINCT FROM lag(section_id) OVER (PARTITION BY doc_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS st FROM h),
u AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS unit FROM m)
SELECT doc_id, printf('unit-%04d', unit::BIGINT) AS unit_id, any_value(section_id) AS section_id, min(seg_idx) AS start_segment, max(seg_idx) AS end_segment FROM u GROUP BY doc_id, unit""")
def semantic_units(spark, d):
    segs = _segments(spark, d)
    three = F.explode(F.array(*[F.struct(F.lit(n).alias("section_id"), F.lit(a).alias("start_segment"), F.lit(b).alias("end_segment")) for n, a, b in (("a", 1, 3), ("b", 3, 5), ("c", 8, 11))])).alias("s")
    sections = segs.select("doc_id").distinct().select("doc_id", three).select("doc_id", "s.section_id", "s.start_segment", "s.end_segment")
    return versions.semantic_units(segs, sections)


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT *, trim(line, ' ') = '' AS blank, regexp_matches(line, '^.{1,25}$') AND trim(line, ' ') <> '' AS head FROM l),
b AS (SELECT *, sum((blank OR head)::INT) OVER w AS block, last_value(CASE WHEN head THEN trim(line, ' ') END IGNORE NULLS) OVER w AS heading FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, any_value(heading) AS heading, min(line_no)::INT AS line_start, max(line_no)::INT AS line_end, sum(length(line))::BIGINT AS chars FROM b WHERE NOT blank AND NOT head GROUP BY doc_id, block""")
def headed_blocks(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return versions.headed_blocks(lines, heading=r"^(?=.*[^ ]).{1,25}$")


@query("WITH c AS (SELECT doc_id AS case_id, source AS category, n_chars % 1000 AS score FROM documents), r AS (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY score DESC, case_id) > 1)::INT AS late FROM c) SELECT case_id, category, score FROM r ORDER BY late, score DESC, case_id LIMIT 24")
def diverse_cases(spark, d):
    return versions.diverse(_docs(spark, d).select(F.col("doc_id").alias("case_id"), F.col("source").alias("category"), (F.col("n_chars") % 1000).alias("score")), most=24)


@query("""WITH a AS (SELECT doc_id AS case_id, unnest([doc_id % 7, doc_id % 11, doc_id % 13]) AS claim FROM documents), b AS (SELECT 's' || k AS section_id, k AS pos, unnest(range(k, k + 4)) AS claim FROM range(10) t(k)),
n AS (SELECT case_id, section_id, pos, count(*) AS n FROM a JOIN b USING (claim) GROUP BY ALL) SELECT case_id, arg_max(section_id, n * 100 - pos) AS section_id, max(n) AS overlap FROM n GROUP BY case_id""")
def outline_closure(spark, d):
    i = F.col("doc_id")
    cases = _docs(spark, d).select(i.alias("case_id"), F.array(i % 7, i % 11, i % 13).alias("claims"))
    sections = spark.range(10).select(F.concat(F.lit("s"), "id").alias("section_id"), F.col("id").alias("pos"), F.sequence("id", F.col("id") + 3).alias("claims"))
    return versions.place_cases(cases, sections)


@query(f"{_WITH_F} SELECT (SELECT count(*) FROM pairs) AS segments, (SELECT sum(length(source)) FROM pairs)::BIGINT AS source_chars, (SELECT sum(length(target)) FROM pairs)::BIGINT AS target_chars, (SELECT count(DISTINCT conv_id) FROM pairs) AS documents, count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'actionable') AS actionable, count(*) FILTER (WHERE severity = 'informational') AS informational FROM f")
def delivery_manifest(spark, d):
    return versions.manifest(_pairs(spark, d), _findings(spark, d))


@query(f"""WITH {_SEG}, r AS (SELECT 'sec' || doc_id || '-' || seg_idx AS section_id, seg_idx, doc_id + CASE WHEN doc_id % 9 = 0 THEN 10000000 ELSE 0 END AS ref, CASE WHEN doc_id % 5 = 0 THEN 'never said' ELSE regexp_replace(substring(text, 1, 20), '[|\\[\\]]', '', 'g') END AS quote, text, doc_id FROM seg)
SELECT 'invented_segment_id' AS type, section_id, ref || ':' || seg_idx AS subject FROM r WHERE doc_id % 9 = 0
UNION ALL SELECT 'wrong_segment_quote', section_id, ref || ':' || seg_idx FROM r WHERE doc_id % 9 <> 0 AND NOT contains(regexp_replace(text, '\\s+', ' ', 'g'), regexp_replace(quote, '\\s+', ' ', 'g'))
UNION ALL SELECT CASE WHEN doc_id % 4 = 3 THEN 'unknown_project_statistic' ELSE 'wrong_project_statistic' END, section_id, 'k' || (doc_id % 4) FROM r WHERE doc_id % 4 = 3 OR doc_id % 4 = 2""".replace("\\\\", "\\"))
def report_marker_violations(spark, d):
    segs = _segments(spark, d)
    i = F.col("doc_id")
    quote = F.when(i % 5 == 0, "never said").otherwise(F.regexp_replace(F.substring("text", 1, 20), r"[|\[\]]", ""))
    ref = i + F.when(i % 9 == 0, 10000000).otherwise(0)
    body = F.concat(F.lit("As [[seg:"), ref, F.lit(":"), "seg_idx", F.lit("|"), quote, F.lit("]] says, {{STAT:k"), i % 4, F.lit("="), F.when(i % 4 == 1, "1,001").when(i % 4 == 0, "1000").otherwise("7"), F.lit("}}."))
    sections = segs.select(F.concat(F.lit("sec"), "doc_id", F.lit("-"), "seg_idx").alias("section_id"), body.alias("body"))
    stats = spark.createDataFrame([("k0", "1,000"), ("k1", "1001"), ("k2", "9")], "key string, value string")
    return versions.report_violations(sections, dealt(segs, table(spark, d, "documents"), "doc_id", "seg_idx"), stats)


@query(f"WITH {_PAIRS} SELECT conv_id, seg_idx, kind FROM (SELECT conv_id, seg_idx, unnest([CASE WHEN conv_id % 4 = 0 THEN 'delivery' END, CASE WHEN (conv_id + seg_idx) % 3 = 0 THEN 'segment' END, CASE WHEN length(target) < 60 THEN 'finding' END]) AS kind FROM pairs) WHERE kind IS NOT NULL")
def human_actions_per_segment(spark, d):
    # an action names a delivery, a segment or a finding: an or of three equi-joins, each on its own key
    p = _pairs(spark, d).select("conv_id", "seg_idx", F.concat_ws(":", "conv_id", "seg_idx").alias("seg"), F.when(F.length("target") < 60, F.concat_ws(":", F.lit("short"), "conv_id", "seg_idx")).alias("finding"))
    whole = p.filter("conv_id % 4 = 0").select("conv_id").distinct()
    single = p.filter("(conv_id + seg_idx) % 3 = 0").select("seg")
    found = p.filter("finding IS NOT NULL").select("finding")
    parts = [p.join(x, key).select("conv_id", "seg_idx", F.lit(kind).alias("kind")) for x, key, kind in ((whole, "conv_id", "delivery"), (single, "seg", "segment"), (found, "finding", "finding"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"WITH {_SEG}, t AS (SELECT doc_id, lag(text) OVER w AS before, text, seg_idx FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)) SELECT doc_id, seg_idx FROM t WHERE length(text) >= 20 AND contains(before, text)")
def neighbour_containment(spark, d):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("seg_idx"))
    return _segments(spark, d).withColumn("before", before).filter((F.length("text") >= 20) & F.contains("before", "text")).select("doc_id", "seg_idx")


@query()
def revision_deltas(spark, d):
    p = _pairs(spark, d).withColumn("d", delta("source", "target"))
    return p.select("conv_id", "seg_idx", F.size("d").alias("n_changes"), meaningful_revision("source", "target").alias("revised"), F.round(similarity("source", "target"), 4).alias("similarity"))


@query()
def tolerant_spans(spark, d):
    needle = F.regexp_replace(F.substring("text", 3, 15), " ", "  ")
    found = _segments(spark, d).withColumn("span", find_span(needle, F.col("text")))
    return found.select("doc_id", "seg_idx", F.col("span.start").alias("start"), F.col("span.end").alias("end"))
