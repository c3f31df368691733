"""Queries over review records; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import review
from glossweave.plans.catalogue import _docs, _PAIRS, _SEG, _WITH_F, _findings, _pairs, _segments, query
from glossweave.sources import derived, jobs
from glossweave.sources.derived import WORD_GLOSSARY_SQL
from glossweave.sources.jobs import FINDING_SQL, RECORD_SQL


@query(f"{_WITH_F} SELECT arm, conv_id, seg_idx, type, 'f-' || substring(sha256(concat_ws('|', type, conv_id, seg_idx, reason)), 1, 12) AS finding_id FROM f")
def finding_ids(spark, d):
    return _findings(spark, d).select("arm", "conv_id", "seg_idx", "type", review.finding_id(*map(F.col, ("type", "conv_id", "seg_idx", "reason"))).alias("finding_id"))


@query(f"""WITH {_PAIRS}, {RECORD_SQL}, {FINDING_SQL}, re AS (SELECT DISTINCT conv_id, seg_idx, 1 AS k FROM fd WHERE action = 'retranslated') SELECT arm, count(*) AS n, round(sum(reviewed::INT) / count(*), 4) AS reviewed_rate,
round(sum((k IS NOT NULL)::INT) / count(*), 4) AS retranslated_rate, round(sum(from_tm::INT) / count(*), 4) AS reuse_rate, round(sum(stale::INT) / count(*), 4) AS stale_rate FROM rec LEFT JOIN re USING (conv_id, seg_idx) GROUP BY arm""")
def workflow_rates(spark, d):
    redone = jobs.findings(spark, d).filter("action = 'retranslated'").select("conv_id", "seg_idx").distinct().withColumn("redone", F.lit(True))
    own = jobs.records(spark, d).join(redone, ["conv_id", "seg_idx"], "left").withColumn("redone", F.coalesce("redone", F.lit(False)))
    return review.workflow_rates(own, {"reviewed_rate": F.col("reviewed"), "retranslated_rate": F.col("redone"), "reuse_rate": F.col("from_tm"), "stale_rate": F.col("stale")}, "arm")


@query(f"WITH {_SEG} SELECT doc_id, seg_idx, list(seg_idx) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM seg")
def neighbors_k(spark, d):
    return review.neighbours(_segments(spark, d), 3)


@query(f"""WITH {_PAIRS}, p AS (SELECT *, conv_id // 2 AS item FROM pairs)
SELECT a.item, a.seg_idx, a.source, a.target AS left_target, coalesce(b.target, '') AS right_target FROM (SELECT * FROM p WHERE arm = 'A') a LEFT JOIN (SELECT * FROM p WHERE arm = 'B') b USING (item, seg_idx)""")
def arms_side_by_side(spark, d):
    pairs = _pairs(spark, d).withColumn("item", F.floor(F.col("conv_id") / 2))
    return review.side_by_side(pairs.filter("arm = 'A'"), pairs.filter("arm = 'B'"), "item", "seg_idx")


@query(f"""{_WITH_F} SELECT conv_id, pairs, coalesce(suspects, 0) AS suspects, coalesce(findings, 0) AS findings FROM (SELECT conv_id, count(*) AS pairs FROM pairs GROUP BY conv_id)
LEFT JOIN (SELECT conv_id, count(*) FILTER (WHERE type = 'incomplete') AS suspects, count(*) AS findings FROM f GROUP BY conv_id) USING (conv_id)""")
def history_summary(spark, d):
    return review.history(_pairs(spark, d), _findings(spark, d))


@query(f"WITH {_PAIRS}, n AS (SELECT arm, conv_id, seg_idx, (row_number() OVER (PARTITION BY arm ORDER BY conv_id DESC, seg_idx DESC))::INT AS back FROM pairs) SELECT * FROM n WHERE back <= 12")
def last_pairs(spark, d):
    return review.last_rows(_pairs(spark, d).select("arm", "conv_id", "seg_idx"), 12, ["conv_id", "seg_idx"], "arm")


@query(f"WITH {WORD_GLOSSARY_SQL} SELECT status, behavior, count(*) AS entries, count(DISTINCT lower(source)) AS terms, sum((len(forbidden) > 0)::INT)::BIGINT AS with_forbidden FROM g GROUP BY ALL")
def glossary_status_counts(spark, d):
    g = derived.word_glossary(_docs(spark, d))
    return g.groupBy("status", "behavior").agg(F.count("*").alias("entries"), F.countDistinct(F.lower("source")).alias("terms"), F.sum((F.size("forbidden") > 0).cast("int")).alias("with_forbidden"))
