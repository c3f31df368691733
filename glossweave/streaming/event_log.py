"""The append-only batch log: last phases, recovery of unpromoted batches, and its stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The phases of a batch, in their order.
PHASES = ("generation_started", "generation_done", "deterministic_qa_done", "semantic_review_done", "semantic_review_skipped", "knowledge_feedback_done", "state_commit_done", "tm_promotion_pending", "tm_promotion_done")
SCHEMA = "batch long, offset long, phase string, segment_count int, entries array<struct<source:string,target:string>>"


def log_of(events: DataFrame) -> DataFrame:
    """A log made of the driver's events: a batch is a user, a phase follows from the event's number."""
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), (F.col("event_id") % len(PHASES) + 1).cast("int"))
    return events.select(F.col("user_id").alias("batch"), F.col("event_id").alias("offset"), phase.alias("phase"))


def last_phase(log: DataFrame) -> DataFrame:
    return log.groupBy("batch").agg(F.max_by("phase", "offset").alias("phase"), F.count("*").alias("n_events"))


def unpromoted(log: DataFrame) -> DataFrame:
    """Batches whose entries wait for promotion and were not promoted after that."""
    done = log.filter("phase = 'tm_promotion_done'").groupBy("batch").agg(F.max("offset").alias("done"))
    waiting = log.filter("phase = 'tm_promotion_pending'").groupBy("batch").agg(F.max("offset").alias("pending"))
    return waiting.join(done, "batch", "left").filter("done IS NULL OR done < pending").select("batch", "pending")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A batch read of JSON lines; malformed ones are skipped."""
    return spark.read.schema(SCHEMA).json(path).filter("phase IS NOT NULL")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path).filter("phase IS NOT NULL")


def append(events: DataFrame, path: str) -> None:
    """Adds events to the log."""
    events.write.mode("append").json(path)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, part) of a promoted memory."""
    return spark.read.schema("source string, target string, part long").json(path)


def promote(spark: SparkSession, log_path: str, memory_path: str, checkpoint: str) -> None:
    """Takes what is new in the log and writes its pending entries to the memory, a folder for each micro-batch: run again after a
    loss, a batch overwrites its own folder. Entries are promoted only after their batch's state is committed, and only if
    no earlier folder has their source; what waits for a commit stays ``unpromoted``."""

    def write(batch: DataFrame, number: int) -> None:
        committed = read_log(spark, log_path).filter("phase = 'state_commit_done'").select("batch").distinct()
        rows = batch.filter("phase = 'tm_promotion_pending'").join(committed, "batch", "left_semi").select(F.inline("entries")).filter("source IS NOT NULL AND trim(target) <> ''")
        rows = rows.groupBy("source").agg(F.min("target").alias("target"))
        if _there(spark, memory_path):
            rows = rows.join(read_memory(spark, memory_path).filter(F.col("part") < number).select("source"), "source", "left_anti")
        rows.write.mode("overwrite").json(f"{memory_path}/part={number}")

    query = stream_log(spark, log_path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
