"""Candidates as a stream against the batch, after retractions and a restart."""

import random

from glossweave.streaming import knowledge

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(events, known):
    """Jobs' candidates by a loop over all events."""
    held = {}
    for job, _, op, source, target, segment in sorted(events, key=lambda e: (e[0], e[1])):
        if op == "retract":
            for k in [k for k, c in held.items() if k[0] == job and segment in c[3]]:
                del held[k]
            continue
        key = (source or "").strip().lower()
        if not key or key in known:
            continue
        c = held.setdefault((job, key), [source, None, segment, set()])
        c[1] = c[1] or (target or "").strip() or None
        c[3].add(segment)
    return {k: (c[0], c[1], c[2], sorted(c[3])) for k, c in held.items()}


def _rows(df):
    return {(r["job"], r["key"]): (r["source"], r["target"], r["first_segment"], list(r["segments"])) for r in df.collect()}


def test_stream_with_retractions_and_restart(spark, tmp_path):
    draw = random.Random(1)
    events = []
    for job in range(5):
        for seq in range(60):
            if draw.random() < 0.2:
                events.append((job, seq, "retract", None, None, draw.randint(0, 9)))
            else:
                events.append((job, seq, "observe", draw.choice(["Alpha", "alpha", "beta ", "Gamma", "delta", "", None]), draw.choice(["x", "y", "", None]), draw.randint(0, 9)))
    df = spark.createDataFrame(events, knowledge.EVENTS)
    glossary = spark.createDataFrame([("GAMMA", "locked", "z")], "source string, status string, preferred string")
    want = _plain(events, {"gamma"})
    assert _rows(knowledge.candidates(df, glossary)) == want and want
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        for part in range(3):
            df.filter(f"seq >= {part * 20} AND seq < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if part:  # the second start takes up the state of the first
                stream = knowledge.candidate_events(spark.readStream.schema(knowledge.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), glossary)
                write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/part={n}")
                stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    changes = spark.read.parquet(f"{tmp_path}/out")
    assert _rows(knowledge.latest(changes)) == want == _rows(knowledge.latest(changes.unionByName(changes)))
    assert {r["kind"] for r in changes.select("kind").distinct().collect()} == {"emergent_candidate", "retracted"}


def test_consistency(spark):
    rows = [(1, 0, "observe", "Bank", "die Böschung", 0), (1, 1, "observe", "bank", "das Ufer", 1), (1, 2, "observe", "bank", "", 2), (1, 3, "observe", "loose", "x", 2), (1, 4, "observe", "other", "x", 3), (1, 5, "retract", None, None, 3)]
    glossary = spark.createDataFrame([("BANK", "locked", "Ufer"), ("loose", "provisional", "y")], "source string, status string, preferred string")
    got = {r["seq"]: r["kind"] for r in knowledge.consistency(spark.createDataFrame(rows, knowledge.EVENTS), glossary).collect()}
    assert got == {0: "target_conflict", 1: "known_consistency", 2: "known_consistency", 3: "known_consistency"}
    assert knowledge.candidates(spark.createDataFrame(rows, knowledge.EVENTS), glossary).count() == 0
