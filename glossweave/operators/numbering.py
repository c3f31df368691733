"""Numbers over a whole table, without a window that puts it into one task."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` has the partition above so many bits, and the row's place in it below.
_BITS = 33


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder of ``spark.checkpoint.dir``; on a local master without one, in a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glossweave"))
    return df.checkpoint()


def numbered(df: DataFrame, *order: Column | str, name: str, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """``df`` with a column ``name``: 1, 2, 3, ... in the given order.

    Spark's ranges are sorted, each in its own task, and kept, so that numbers don't move if a task runs again. A range's first number is the
    count of all rows in the ranges before it. Rows that are equal in ``order`` may lie in one range; give a column that tells repeated rows apart if these may be many.
    An empty table has no numbers."""
    row = f"{name}__at"
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    part = F.shiftright(row, _BITS)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts, before = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    if not starts:
        return placed.withColumn(name, F.lit(None).cast("long")).drop(row)
    first = F.get(F.array(*(F.lit(x).cast("long") for x in starts)), part.cast("int"))
    return placed.withColumn(name, first + F.col(row).bitwiseAND(F.lit((1 << _BITS) - 1)) + 1).drop(row)
