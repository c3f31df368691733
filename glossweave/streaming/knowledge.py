"""What translations teach as they come: candidates for a glossary, observed, counted and taken back, as a batch and as a stream.

Events are (job, seq, op, source, target, segment): ``observe`` says that a source was rendered by a target in a segment, ``retract`` that a segment is no longer valid.
A source that the glossary has gives an event of its own and no candidate. Of others the first target that isn't blank stands, segments are gathered, and a
retracted segment takes every candidate with it that rests on it, whatever else it rests on; what is observed later begins anew.

The stream keeps a map of candidates for each job in Spark's state store, and gives an event for every change, numbered by a version. The latest event of each
source is then the candidate as the batch has it. Events of a job are taken in the order of ``seq`` within a micro-batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glossweave.shipping import ship

EVENTS = "job long, seq long, op string, source string, target string, segment int"
_CANDIDATE = "source string, target string, first_segment int, segments array<int>, version long"
_OUT = "job long, seq long, kind string, key string, source string, target string, first_segment int, segments array<int>, version long"


def _known(events: DataFrame, glossary: DataFrame) -> DataFrame:
    """Events with the key of their source, and the status and preferred form that the glossary has of it."""
    entries = glossary.select(F.lower(F.trim("source")).alias("key"), F.col("status").alias("known"), F.col("preferred"))
    return events.withColumn("key", F.lower(F.trim("source"))).join(entries, "key", "left")


def _conflict() -> Column:
    c = F.col
    return (c("known") == "locked") & (F.coalesce(c("preferred"), F.lit("")) != "") & (F.coalesce(c("target"), F.lit("")) != "") & ~F.contains("target", "preferred")


def consistency(events: DataFrame, glossary: DataFrame) -> DataFrame:
    """(job, seq, kind, source, target) of observed sources that the glossary has; glossary(source, status, preferred), one row a source whatever its case."""
    own = _known(events.filter("op = 'observe'"), glossary).filter("known IS NOT NULL")
    return own.select("job", "seq", F.when(F.coalesce(_conflict(), F.lit(False)), "target_conflict").otherwise("known_consistency").alias("kind"), "source", "target")


def candidates(events: DataFrame, glossary: DataFrame) -> DataFrame:
    """(job, key, source, target, first_segment, segments, version) of the candidates that stand after all events.

    A retraction meets the sources that observed its segment, and no others; what happened to a source is folded in order."""
    seen = _known(events.filter("op = 'observe'"), glossary).filter("known IS NULL AND key <> ''").select("job", "key", "seq", F.lit(False).alias("gone"), "source", F.nullif(F.trim("target"), F.lit("")).alias("target"), "segment")
    gone = events.filter("op = 'retract'").select("job", "segment", "seq")
    met = seen.select("job", "key", "segment").distinct().join(gone, ["job", "segment"]).select("job", "key", "seq", F.lit(True).alias("gone"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), "segment")
    steps = seen.unionByName(met).groupBy("job", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "gone", "segment", "source", "target"))).alias("steps"))
    none = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("first_segment"), F.array().cast("array<int>").alias("segments"), F.lit(0).cast("long").alias("version"))

    def step(u: Column, x: Column) -> Column:
        held = F.array_contains(u["segments"], x["segment"])
        emptied = F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("first_segment"), F.array().cast("array<int>").alias("segments"), (u["version"] + 1).alias("version"))
        more = F.struct(
            F.coalesce(u["source"], x["source"]).alias("source"), F.coalesce(u["target"], x["target"]).alias("target"), F.coalesce(u["first_segment"], x["segment"]).alias("first_segment"),
            F.array_sort(F.array_union(u["segments"], F.array(x["segment"]))).alias("segments"), (u["version"] + 1).alias("version"),
        )
        return F.when(~x["gone"], more).when(held, emptied).otherwise(u)

    return steps.select("job", "key", F.aggregate("steps", none, step).alias("c")).select("job", "key", "c.*").filter("size(segments) > 0")


class Candidates(StatefulProcessor):
    """A job's candidates by their key, in a map of the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("candidates", "key string", _CANDIDATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        out = []
        told = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in told.itertuples(index=False):
            if r.op == "retract":
                for (name,), c in list(self.held.iterator()):
                    if r.segment in c[3]:
                        gone = (None, None, None, [], c[4] + 1)
                        self.held.updateValue((name,), gone)
                        out.append((key[0], r.seq, "retracted", name, *gone))
                continue
            if not r.key:
                continue
            old = self.held.getValue((r.key,)) if self.held.containsKey((r.key,)) else (None, None, None, [], 0)
            target = (r.target or "").strip() or None
            new = (old[0] or r.source, old[1] or target, int(r.segment) if old[2] is None else old[2], sorted({*map(int, old[3]), int(r.segment)}), int(old[4]) + 1)
            self.held.updateValue((r.key,), new)
            out.append((key[0], r.seq, "emergent_candidate", r.key, *new))
        yield pd.DataFrame(out, columns=["job", "seq", "kind", "key", "source", "target", "first_segment", "segments", "version"]).astype({"first_segment": "Int32", "version": "int64"})

    def close(self) -> None:
        pass


def candidate_events(events: DataFrame, glossary: DataFrame) -> DataFrame:
    """A stream of events as a stream of changes to candidates. The session needs Spark's RocksDB state store."""
    ship(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark starts a processor on the driver too, in a process that doesn't get the files shipped to workers
    own = _known(events, glossary).filter("op = 'retract' OR known IS NULL").select("job", "seq", "op", "key", "source", "target", "segment")
    return own.groupBy("job").transformWithStateInPandas(Candidates(), _OUT, "Update", "None")


def latest(changes: DataFrame) -> DataFrame:
    """The candidates that stand after the changes of a stream, however often a change was written."""
    c = F.max_by(F.struct("source", "target", "first_segment", "segments", "version"), "version").alias("c")
    return changes.groupBy("job", "key").agg(c).select("job", "key", "c.*").filter("size(segments) > 0")
