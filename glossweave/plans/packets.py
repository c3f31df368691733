"""Queries over samples for blind review; they join the catalogue's."""

from __future__ import annotations


from pyspark.sql import functions as F

from glossweave.operators import packets, sampling
from glossweave.operators.matching import term_matches_in, with_term_count
from glossweave.plans.catalogue import _G, _SEG, _match, _segments, query
from glossweave.sources import derived

# Two arms over all segments: one has the text, the other an edit of some. The second pair of arms agrees but for a few, so that identical rows fill the packet.
_ARMS = {"target_a": "text", "target_b": "CASE WHEN (doc_id + seg_idx) % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END", "flagged": "(doc_id * 7 + seg_idx) % 50 = 0"}
_FEW = {**_ARMS, "target_b": "CASE WHEN doc_id % 100 = 7 AND seg_idx < 2 THEN 'other' ELSE text END"}


def _packet(spark, d, arms):
    segs = with_term_count(_segments(spark, d), derived.glossary(spark).filter("status = 'locked'"), name="n_terms")
    return sampling.blind_packet(segs.selectExpr("doc_id", "seg_idx", "text AS source", *[f"{x} AS {name}" for name, x in arms.items()], "n_terms"), "doc_id", "seg_idx")


def _sql(arms: dict[str, str]) -> str:
    own = ", ".join(f"{x} AS {name}" for name, x in arms.items())
    taken = "SELECT doc_id, seg_idx FROM"
    return f"""WITH {_SEG}, {_G}, tc AS (SELECT doc_id, seg_idx, count(*) AS n_terms FROM seg JOIN g ON {_match('g.source', 'text')} WHERE status = 'locked' GROUP BY ALL),
rw AS (SELECT doc_id, seg_idx, text AS source, {own}, coalesce(n_terms, 0) AS n_terms, length(text) + 8 * len(regexp_extract_all(text, '\\. ')) AS dense, md5('7:' || doc_id || ':' || seg_idx) AS hash FROM seg LEFT JOIN tc USING (doc_id, seg_idx)), df AS (SELECT * FROM rw WHERE target_a <> target_b),
q1 AS (SELECT *, 1 AS st, row_number() OVER () AS o FROM (SELECT doc_id, seg_idx FROM df WHERE n_terms > 0 ORDER BY n_terms DESC, doc_id, seg_idx LIMIT 15)),
q2 AS (SELECT *, 2, row_number() OVER () FROM (SELECT doc_id, seg_idx FROM df WHERE flagged ORDER BY doc_id, seg_idx LIMIT 15)), q3 AS (SELECT *, 3, row_number() OVER () FROM (SELECT doc_id, seg_idx FROM df ORDER BY dense DESC, doc_id, seg_idx LIMIT 10)),
t3 AS (SELECT doc_id, seg_idx, min(st * 1000 + o) AS o FROM (FROM q1 UNION ALL FROM q2 UNION ALL FROM q3) GROUP BY ALL),
q4 AS (SELECT *, 4000 + row_number() OVER () AS o FROM (SELECT doc_id, seg_idx FROM df ORDER BY hash, doc_id, seg_idx LIMIT (SELECT 80 - count(*) FROM t3))), t4 AS (FROM t3 UNION ALL FROM q4 WHERE (doc_id, seg_idx) NOT IN ({taken} t3)),
q5 AS (SELECT *, 5000 + row_number() OVER () AS o FROM (SELECT doc_id, seg_idx FROM df WHERE (doc_id, seg_idx) NOT IN ({taken} t4) ORDER BY doc_id, seg_idx LIMIT (SELECT 80 - count(*) FROM t4))), t5 AS (FROM t4 UNION ALL FROM q5),
q6 AS (SELECT *, 6000 + row_number() OVER () AS o FROM (SELECT doc_id, seg_idx FROM rw WHERE target_a = target_b ORDER BY doc_id, seg_idx LIMIT (SELECT 80 - count(*) FROM t5))), t6 AS (FROM t5 UNION ALL FROM q6),
dl AS (SELECT *, (row_number() OVER (ORDER BY o))::INT AS packet_id, CASE WHEN row_number() OVER (ORDER BY md5('7:side:' || doc_id || ':' || seg_idx), doc_id, seg_idx) <= (SELECT count(*) FROM t6) // 2 THEN 'A' ELSE 'B' END AS "left" FROM t6),
pk AS (SELECT packet_id, CASE o // 1000 WHEN 1 THEN 'term_dense' WHEN 2 THEN 'repair_review' WHEN 3 THEN 'long_dense' WHEN 4 THEN 'random' WHEN 5 THEN 'random_fill' ELSE 'identical_fallback' END AS category, doc_id, seg_idx, source,
CASE WHEN "left" = 'A' THEN target_a ELSE target_b END AS candidate_a, CASE WHEN "left" = 'A' THEN target_b ELSE target_a END AS candidate_b, "left", target_a = target_b AS identical FROM dl JOIN rw USING (doc_id, seg_idx))"""


@query(f"{_sql(_ARMS)} SELECT * FROM pk")
def blind_packet(spark, d):
    return _packet(spark, d, _ARMS)


@query(f"{_sql(_FEW)} SELECT * FROM pk")
def blind_packet_of_few(spark, d):
    return _packet(spark, d, _FEW)


@query(f"""{_sql(_FEW)} SELECT coalesce(category, 'all') AS category, count(*) AS n, count(*) FILTER ("left" = 'A') AS left_a, count(*) FILTER (identical) AS n_identical FROM pk GROUP BY ROLLUP (category)""")
def blind_packet_counts(spark, d):
    return sampling.packet_counts(_packet(spark, d, _FEW))


# Units of seven segments: of every third document they tile it, of the next a unit is missing, of the next each reaches into the following one; wrong ones stand between.
_START, _END = "k * 7", "CASE WHEN doc_id % 3 = 2 THEN least(k * 7 + 7, last) ELSE least(k * 7 + 6, last) END"


def _units(spark, d):
    last = _segments(spark, d).groupBy("doc_id").agg(F.max("seg_idx").alias("last"))
    each = last.select("doc_id", "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 7))).alias("k")).filter("NOT (doc_id % 3 = 1 AND k = 1)")
    real = each.selectExpr("doc_id", f"CAST({_START} AS STRING) AS start_segment", f"CAST({_END} AS STRING) AS end_segment")
    wrong = last.filter("doc_id % 2 = 0").selectExpr("doc_id", "'none' AS start_segment", "'3' AS end_segment").unionByName(last.selectExpr("doc_id", "'5' AS start_segment", "CAST(last + 9 AS STRING) AS end_segment"))
    return real.unionByName(wrong)


_TILED = f"""{{seg}}, la AS (SELECT doc_id, max(seg_idx) AS last FROM seg GROUP BY doc_id), un AS (SELECT doc_id, {_START} AS a, {_END} AS z FROM (SELECT doc_id, last, unnest(range(0, last // 7 + 1)) AS k FROM la) WHERE NOT (doc_id % 3 = 1 AND k = 1)),
cov AS (SELECT doc_id, unnest(range(a, z + 1)) AS i FROM un), til AS (SELECT doc_id FROM cov JOIN la USING (doc_id) GROUP BY doc_id, last HAVING count(*) = last + 1 AND count(DISTINCT i) = last + 1),
s AS (SELECT seg.doc_id, seg_idx, length(text) AS n, a AS unit FROM seg LEFT JOIN (un JOIN til USING (doc_id)) u ON u.doc_id = seg.doc_id AND seg_idx BETWEEN a AND z)"""


@query(f"""WITH RECURSIVE {_TILED.format(seg=_SEG)},
b AS (SELECT doc_id, seg_idx, n, unit, 1 AS cnt, n AS size, 0 AS batch FROM s WHERE seg_idx = 0 UNION ALL SELECT doc_id, seg_idx, n, unit, CASE WHEN nw THEN 1 ELSE cnt + 1 END, CASE WHEN nw THEN n ELSE size + n END, CASE WHEN nw THEN batch + 1 ELSE batch END
FROM (SELECT s.*, cnt, size, batch, cnt >= 4 OR size + s.n > 1600 OR s.unit IS DISTINCT FROM b.unit AS nw FROM b JOIN s ON s.doc_id = b.doc_id AND s.seg_idx = b.seg_idx + 1)) SELECT doc_id, seg_idx, batch FROM b""")
def unit_tiled_batches(spark, d):
    return packets.pack_units(_segments(spark, d), _units(spark, d))


# Sections of ten segments with what they plan: claims and cases, some of them unknown or not allowed. Every third section is about terms.
_TITLE, _CLAIM = "CASE WHEN k % 3 = 0 THEN '术语处理' ELSE 'Analysis' END", "'claim-' || (seg_idx % 9)"
_PLANNED = "'seg-' || doc_id || '-' || seg_idx"


@query(f"""WITH {_SEG}, {_G}, se AS (SELECT DISTINCT doc_id, seg_idx // 10 AS k FROM seg), ed AS (SELECT doc_id, seg_idx // 10 AS k, 'claim' AS kind, {_CLAIM} AS ref, seg_idx AS pos, NULL AS at FROM seg WHERE seg_idx % 2 = 0 AND seg_idx % 9 < 6
UNION ALL SELECT doc_id, seg_idx // 10, 'case', {_PLANNED}, seg_idx, seg_idx FROM seg WHERE seg_idx % 4 = 1 AND length(text) >= 60), nu AS (SELECT doc_id, seg_idx, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS n, count(*) OVER (PARTITION BY doc_id) AS size FROM seg),
pk AS (SELECT doc_id, k, kind, ref, pos FROM ed UNION ALL SELECT se.doc_id, k, 'segment', seg_idx::VARCHAR, n FROM se JOIN nu ON nu.doc_id = se.doc_id AND (n < 40 OR n = size)
UNION ALL SELECT se.doc_id, k, 'term', id, pos FROM se, (SELECT id, pos FROM g ORDER BY pos, id LIMIT 5) WHERE k % 3 = 0
UNION ALL SELECT DISTINCT ed.doc_id, k, 'term', g.id, g.pos FROM ed JOIN seg ON seg.doc_id = ed.doc_id AND seg_idx = ed.at JOIN g ON {_match('g.source', 'text')} WHERE k % 3 <> 0)
SELECT doc_id, 's' || k AS section_id, kind, row_number() OVER (PARTITION BY doc_id, k, kind ORDER BY pos, ref) AS n, ref FROM pk""")
def section_packets(spark, d):
    segs = _segments(spark, d)
    placed = segs.withColumn("k", F.floor(F.col("seg_idx") / 10))
    sections = placed.select("doc_id", "k").distinct().selectExpr("doc_id", "'s' || k AS section_id", f"{_TITLE} AS title", "'' AS purpose")
    claims = placed.filter("seg_idx % 2 = 0").selectExpr("doc_id", "'s' || k AS section_id", "'claim' AS kind", f"{_CLAIM} AS ref", "seg_idx AS pos", "CAST(NULL AS INT) AS seg_idx")
    planned = placed.filter("seg_idx % 4 = 1").selectExpr("doc_id", "'s' || k AS section_id", "'case' AS kind", f"{_PLANNED} AS ref", "seg_idx AS pos", "seg_idx")
    # six of nine claims are known; short cases aren't allowed
    known = spark.range(9).selectExpr("'claim' AS kind", "'claim-' || id AS ref", "id < 6 AS allowed").unionByName(segs.selectExpr("'case' AS kind", f"{_PLANNED} AS ref", "length(text) >= 60 AS allowed"))
    glossary = derived.glossary(spark)
    injected = term_matches_in(segs, glossary.select("id", "source"), keep=["doc_id", "seg_idx"]).select("doc_id", "seg_idx", "id")
    return packets.section_packets(sections, claims.unionByName(planned), known, segs, glossary.select("id", "pos"), injected, terms=5)
