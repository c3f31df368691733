"""Job records derived from the driver's tables: pairs with their review state, findings, memory and glossary versions.

The expressions are SQL that Spark and DuckDB read alike, so queries and their SQL share them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.sources.derived import pairs, table

#: What a job holds of each pair besides its texts.
PAIR = {
    "reviewed": "(conv_id + seg_idx) % 4 <> 1",
    "from_tm": "(conv_id * 3 + seg_idx) % 10 = 0",
    "stale": "(conv_id * 5 + seg_idx) % 11 = 0",
    "human_accepted": "(conv_id + seg_idx) % 13 = 0",
    "provenance": "CASE (conv_id + seg_idx) % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'tm_approved' WHEN 2 THEN 'reviewed' ELSE 'generated' END",
    "initial_target": "CASE conv_id % 4 WHEN 0 THEN target WHEN 1 THEN substring(target, 1, CAST(floor(length(target) / 2.0) AS INT)) WHEN 2 THEN replace(target, '.', ' ;') END",
}
#: Of an event: the finding that it records.
FINDING = {
    "seg_idx": "2 * (event_id % 4)",
    "type": "event_type",
    "severity": "CASE WHEN value < 10 THEN 'blocking' WHEN value < 30 THEN 'actionable' ELSE 'informational' END",
    "reason": "props",
    "resolved": "event_id % 3 = 0",
    "action": "CASE event_id % 9 WHEN 0 THEN 'accepted_risk' WHEN 3 THEN 'human_fixed' WHEN 6 THEN 'retranslated' END",
    "conflict": "event_type = 'error'",
}
#: Milestones of a job.
JOB = {
    "p1_done": "conv_id % 10 <> 0", "p2_done": "conv_id % 10 > 4", "frozen": "conv_id % 3 = 0", "bypass": "conv_id % 7 = 0", "has_terms": "conv_id % 4 = 1", "profile_done": "conv_id % 2 = 0",
    "academic": "CASE conv_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'in_progress' ELSE 'none' END", "quality": "CASE conv_id % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'review_required' ELSE 'pass' END",
    "p3_done": "conv_id % 8 = 7", "annotations_done": "conv_id % 2 = 1", "strict": "conv_id % 2 = 0", "approved": "conv_id % 9 = 8",
}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


FINDING_SQL = f"fd AS (SELECT event_id, (user_id * 100 + CAST(json_extract_string(props, '$.k') AS INT)) % 1000 AS conv_id, {_sql(FINDING)} FROM events)"
RECORD_SQL = f"rec AS (SELECT *, {_sql(PAIR)} FROM pairs)"
JOB_SQL = f"job AS (SELECT conv_id, {_sql(JOB)} FROM (SELECT DISTINCT conv_id FROM pairs))"


def records(spark: SparkSession, sf_dir: str, *, deal: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(conv_id, seg_idx, arm, source, target) with the columns of ``PAIR``."""
    return pairs(table(spark, sf_dir, "conversations"), deal=deal).selectExpr("*", *[f"{x} AS {name}" for name, x in PAIR.items()])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, conv_id) with the columns of ``FINDING``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("*", ((F.col("user_id") * 100 + k) % 1000).alias("conv_id")).selectExpr("event_id", "conv_id", *[f"{x} AS {name}" for name, x in FINDING.items()])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "conversations")).select("conv_id").distinct().selectExpr("conv_id", *[f"{x} AS {name}" for name, x in JOB.items()])
