"""Review records: finding ids, rates, neighbours, arms side by side, history, and choices among cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding_id(*parts: Column) -> Column:
    """Stable id of a finding: equal parts, equal id."""
    return F.concat(F.lit("f-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12))


def workflow_rates(pairs: DataFrame, flags: dict[str, Column], *keys: str) -> DataFrame:
    """Share of the rows of each group with each flag, to four places; a null flag isn't set."""
    one = [F.round(F.sum(F.coalesce(c.cast("int"), F.lit(0))) / F.count("*"), 4).alias(name) for name, c in flags.items()]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), *one)


def neighbours(segments: DataFrame, k: int) -> DataFrame:
    """For each segment: the segments at most ``k`` (0 to 5) before and after it, itself included."""
    k = max(0, min(5, k))
    frame = Window.partitionBy("doc_id").orderBy("seg_idx").rowsBetween(-k, k)
    return segments.select("doc_id", "seg_idx", F.collect_list("seg_idx").over(frame).alias("near"))


def side_by_side(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """``left`` with the right target at the same place, empty where there is none."""
    other = right.select(*keys, F.col("target").alias("right_target"))
    return left.select(*keys, "source", F.col("target").alias("left_target")).join(other, list(keys), "left").withColumn("right_target", F.coalesce("right_target", F.lit("")))


def history(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Per job: its pairs, those that look incomplete, and all findings."""
    counts = found.groupBy("conv_id").agg(F.count_if(F.col("type") == "incomplete").alias("suspects"), F.count("*").alias("findings"))
    jobs = pairs.groupBy("conv_id").agg(F.count("*").alias("pairs"))
    return jobs.join(counts, "conv_id", "left").fillna(0, ["suspects", "findings"])


def last_rows(rows: DataFrame, n: int, by: list[str], *keys: str) -> DataFrame:
    """The last ``n`` rows of each group in the order of ``by``, numbered from the last."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)
