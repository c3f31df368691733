"""Queries over divisions of a text that changed; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import alignment
from glossweave.plans.catalogue import _SEG, _segments, _sentences, query
from glossweave.sources.derived import gathered, segments, table

# The new text: some paragraphs are lost, some changed, the rest merged two by two, and new ones stand between. Expressions that Spark and DuckDB read alike.
_KEPT, _EDITED, _BLANK, _CUT = "seg_idx % 7 <> 3", "seg_idx % 11 = 4", "seg_idx % 13 = 5", "seg_idx % 17 = 6"
_CHANGED = f"CASE WHEN {_EDITED} THEN text || ' and more' ELSE replace(text, '''', '’') END"
_TARGET = f"CASE WHEN {_BLANK} THEN ' ' WHEN {_CUT} THEN substring(text, 1, 5) ELSE '<' || text || '> ' END"


def _divisions(segs):
    old = segs.selectExpr("doc_id", "seg_idx", "text AS source", f"{_TARGET} AS target")
    parts = segs.filter(_KEPT).selectExpr("doc_id", "seg_idx", f"{_CHANGED} AS text", "CAST(floor(seg_idx / 2) AS INT) * 2 AS new_idx")
    merged = parts.groupBy("doc_id", "new_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    inserted = segs.filter("seg_idx % 10 = 9").selectExpr("doc_id", "seg_idx + 2 - seg_idx % 2 - 1 AS new_idx", "'inserted ' || seg_idx AS text")
    return old, merged.unionByName(inserted.withColumn("new_idx", F.col("new_idx").cast("int")))


_N = lambda c: rf"lower(regexp_replace(replace(translate({c}, '’‘“”–—', '''''\"\"--'), '…', '...'), '\s+', '', 'g'))"
_STRIP = r"regexp_replace(target, '^\s+|\s+$', '', 'g')"
_Q = "(CASE WHEN strpos(substr(stream, u.here + 1), x.form) > 0 THEN u.here + strpos(substr(stream, u.here + 1), x.form) ELSE strpos(stream, x.form) END)"
_ALIGNED = rf"""WITH {_SEG}, old AS (SELECT doc_id, seg_idx, text AS source, {_TARGET} AS target, {_N("text")} AS form FROM seg),
new AS (SELECT doc_id, (seg_idx // 2 * 2)::INT AS new_idx, string_agg({_CHANGED}, ' ' ORDER BY seg_idx) AS text FROM seg WHERE {_KEPT} GROUP BY ALL UNION ALL SELECT doc_id, (seg_idx + 1 - seg_idx % 2)::INT, 'inserted ' || seg_idx FROM seg WHERE seg_idx % 10 = 9),
nf AS (SELECT *, length(form) AS n, sum(length(form)) OVER (PARTITION BY doc_id ORDER BY new_idx) - length(form) AS start FROM (SELECT *, {_N("text")} AS form FROM new)),
st AS (SELECT doc_id, string_agg(form, '' ORDER BY new_idx) AS stream FROM nf GROUP BY doc_id),
lo AS (SELECT *, CASE WHEN form = '' THEN 'empty' WHEN {_STRIP} = '' OR (length(source) >= 120 AND length({_STRIP}) < 0.15 * length(source)) OR ({_sentences("source")} >= 2 AND {_sentences(_STRIP)} < 0.5 * {_sentences("source")} AND length({_STRIP}) < 0.35 * length(source)) THEN 'suspect' END AS fit FROM old),
ask AS (SELECT doc_id, list(seg_idx ORDER BY seg_idx) AS idx, list(form ORDER BY seg_idx) AS forms FROM lo WHERE fit IS NULL GROUP BY doc_id),
met AS (SELECT doc_id, idx, forms, list_reduce(list_transform(forms, lambda f: {{'here': 0::BIGINT, 'form': f, 'ps': []::BIGINT[]}}), lambda u, x: {{'here': CASE WHEN {_Q} > 0 THEN {_Q} - 1 + length(x.form) ELSE u.here END, 'form': x.form, 'ps': list_append(u.ps, {_Q})}},
  {{'here': 0::BIGINT, 'form': '', 'ps': []::BIGINT[]}}) AS m FROM ask JOIN st USING (doc_id)),
pl AS (SELECT doc_id, seg_idx, p - 1 AS a, p + n - 2 AS b FROM (SELECT doc_id, unnest(idx) AS seg_idx, unnest(m.ps) AS p, unnest(list_transform(forms, lambda f: length(f))) AS n FROM met) WHERE p > 0),
pa AS (SELECT p.doc_id, p.seg_idx, max(new_idx) FILTER (start <= a) AS first_new, max(new_idx) FILTER (start <= b) AS last_new FROM pl p JOIN nf ON nf.doc_id = p.doc_id GROUP BY ALL),
placed AS (SELECT lo.*, coalesce(fit, CASE WHEN first_new IS NULL THEN 'not_found' ELSE 'placed' END) AS state, first_new, last_new FROM lo LEFT JOIN pa USING (doc_id, seg_idx)),
reused AS (SELECT w.doc_id, w.new_idx, w.n_old, w.target FROM (SELECT doc_id, first_new AS new_idx, count(*)::INT AS n_old, string_agg(form, '' ORDER BY seg_idx) AS form, string_agg({_STRIP}, ' ' ORDER BY seg_idx) AS target FROM placed WHERE first_new = last_new GROUP BY ALL) w
  JOIN nf ON nf.doc_id = w.doc_id AND nf.new_idx = w.new_idx AND nf.form = w.form)"""


@query(f"{_ALIGNED} SELECT doc_id, seg_idx, state, first_new, last_new FROM placed")
def stream_align_changed(spark, d):
    return alignment.placements(*_divisions(_segments(spark, d))).select("doc_id", "seg_idx", "state", "first_new", "last_new")


@query(f"{_ALIGNED} SELECT * FROM reused")
def stream_align_carried(spark, d):
    old, new = _divisions(_segments(spark, d))
    return alignment.reused(alignment.placements(old, new), new)


@query(f"{_ALIGNED} SELECT p.*, coalesce(new_total, 0) AS new_total, coalesce(reused, 0) AS reused FROM (SELECT doc_id, count(*) AS old_total, count(*) FILTER (state = 'suspect') AS skipped_suspect, count(*) FILTER (state = 'not_found') AS not_found FROM placed GROUP BY doc_id) p LEFT JOIN (SELECT doc_id, count(*) AS new_total FROM new GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS reused FROM reused GROUP BY doc_id) USING (doc_id)")
def stream_align_statistics(spark, d):
    docs = table(spark, d, "documents")
    return alignment.alignment_statistics(*_divisions(segments(docs, deal=gathered(docs))))
