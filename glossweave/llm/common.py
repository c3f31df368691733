"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_MADE: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it has fewer partitions than there are: a small file with one row group would be one task's work. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as ``spark-submit --py-files`` would. Batches of rows for Python are made
    smaller than Spark's default, which is for short rows; a setting of the user's own stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without it, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = getattr(spark.sparkContext, "_glossweave_dir", None) or tempfile.mkdtemp(prefix="glossweave")
        spark.sparkContext._glossweave_dir = made
        found = f"file://{made}"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, *, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.written_at)


def new_path(spark: SparkSession) -> str:
    """A place for a table. The application's folder goes with the application, whatever is left in it."""
    folder = shared_dir(spark)
    fs, p = _file_system(spark, folder)
    if folder not in _MADE:
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MADE.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def own_columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, as the given names: whatever else the table holds can't clash with what an operator adds."""
    return df.select(*(df[c].alias(new) for new, c in names.items()))


def in_parts(batches: Iterator[pa.RecordBatch], text: str, *, rows: int, octets: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows again, so many at a time and so many bytes of text; a longer text is a part by itself."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        k = 0
        while k < batch.num_rows:
            most = np.searchsorted(ends, (ends[k - 1] if k else 0) + octets, side="right")
            n = max(1, min(rows, int(most) - k))
            yield batch.slice(k, n)
            k += n


def groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """The rows of each group; rows of a group come in a row."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in by])
        cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows])).tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = tuple(keys[:, x])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = own
    if held:
        yield pa.Table.from_batches(held)
