"""Queries over what translations teach; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.plans.catalogue import _G, _PAIRS, _pairs, query
from glossweave.sources import derived
from glossweave.streaming import knowledge

# Every word of a source is observed with the first longer word of its target; some segments are retracted some segments later.
_WORDS, _GONE = "[A-Za-z]{3,}", "(conv_id + seg_idx) % 3 = 0"
_EVENTS = f"""ob AS (SELECT conv_id AS job, (seg_idx * 1000 + unnest(range(len(w))))::BIGINT AS seq, unnest(w) AS source, regexp_extract(target, '[A-Za-z]{{4,}}') AS target, seg_idx AS segment FROM (SELECT *, regexp_extract_all(source, '{_WORDS}') AS w FROM pairs)),
re AS (SELECT conv_id AS job, ((seg_idx + 4) * 1000 + 999)::BIGINT AS seq, seg_idx AS segment FROM pairs WHERE {_GONE}),
kn AS (SELECT ob.*, lower(ob.source) AS key, g.status, g.preferred FROM ob LEFT JOIN (SELECT lower(source) AS k, arg_max(status, pos) AS status, arg_max(preferred, pos) AS preferred FROM g GROUP BY 1) g ON g.k = lower(ob.source))"""


def _events(spark, d):
    own = _pairs(spark, d)
    seen = own.select("conv_id", "seg_idx", F.regexp_extract("target", "[A-Za-z]{4,}", 0).alias("target"), F.posexplode(F.regexp_extract_all("source", F.lit(_WORDS), F.lit(0))).alias("k", "source"))
    seen = seen.selectExpr("conv_id AS job", "CAST(seg_idx * 1000 + k AS BIGINT) AS seq", "'observe' AS op", "source", "target", "CAST(seg_idx AS INT) AS segment")
    gone = own.filter(_GONE).selectExpr("conv_id AS job", "CAST((seg_idx + 4) * 1000 + 999 AS BIGINT) AS seq", "'retract' AS op", "CAST(NULL AS STRING) AS source", "CAST(NULL AS STRING) AS target", "CAST(seg_idx AS INT) AS segment")
    return seen.unionByName(gone)


def _entries(spark):
    """One entry for each source whatever its case, the last."""
    return derived.glossary(spark).groupBy(F.lower("source").alias("source")).agg(F.max_by("status", "pos").alias("status"), F.max_by("preferred", "pos").alias("preferred"))


@query(f"""WITH {_PAIRS}, {_G}, {_EVENTS}, sn AS (SELECT job, key, seq, false AS gone, source, nullif(target, '') AS target, segment FROM kn WHERE status IS NULL),
st AS (SELECT * FROM sn UNION ALL SELECT job, key, re.seq, true, NULL, NULL, segment FROM (SELECT DISTINCT job, key, segment FROM sn) JOIN re USING (job, segment)),
fo AS (SELECT job, key, list({{'gone': gone, 'segment': segment, 'source': source, 'target': target, 'first': NULL::INT, 'segs': []::INT[], 'version': 0::BIGINT}} ORDER BY seq) AS steps FROM st GROUP BY ALL),
re2 AS (SELECT job, key, list_reduce(steps, lambda u, x: CASE WHEN NOT x.gone THEN {{'gone': false, 'segment': x.segment, 'source': coalesce(u.source, x.source), 'target': coalesce(u.target, x.target), 'first': coalesce(u.first, x.segment), 'segs': list_sort(list_distinct(list_append(u.segs, x.segment))), 'version': u.version + 1}}
  WHEN list_contains(u.segs, x.segment) THEN {{'gone': true, 'segment': x.segment, 'source': NULL, 'target': NULL, 'first': NULL, 'segs': []::INT[], 'version': u.version + 1}} ELSE u END,
  {{'gone': false, 'segment': 0, 'source': NULL::VARCHAR, 'target': NULL::VARCHAR, 'first': NULL::INT, 'segs': []::INT[], 'version': 0::BIGINT}}) AS c FROM fo)
SELECT job, key, c.source AS source, c.target AS target, c.first AS first_segment, array_to_string(c.segs, ',') AS segments, c.version AS version FROM re2 WHERE len(c.segs) > 0""")
def knowledge_candidates(spark, d):
    return knowledge.candidates(_events(spark, d), _entries(spark)).withColumn("segments", F.array_join("segments", ","))


@query(f"WITH {_PAIRS}, {_G}, {_EVENTS} SELECT job, seq, CASE WHEN status = 'locked' AND preferred <> '' AND target <> '' AND NOT contains(target, preferred) THEN 'target_conflict' ELSE 'known_consistency' END AS kind, source, target FROM kn WHERE status IS NOT NULL")
def knowledge_consistency(spark, d):
    return knowledge.consistency(_events(spark, d), _entries(spark))
