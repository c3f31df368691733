"""Readers and sinks of a harness: memories, glossaries, runs, packets."""

import json

from glossweave.sources import files


def test_memory(spark, tmp_path):
    memory = {"A line.": {"target": "Zeile", "reviewed": True}, "unread": {"target": "x"}, "***": {"target": "x", "reviewed": True}, "blank": {"target": " ", "reviewed": True}, "no": {"target": "x", "reviewed": False}, "odd": "text", "null": None, "one": {"target": "eins", "reviewed": 1}}
    (tmp_path / "m.json").write_text(json.dumps(memory, ensure_ascii=False, indent=1))
    (tmp_path / "broken.json").write_text("{not json")
    assert sorted(map(tuple, files.read_memory(spark, f"{tmp_path}/*.json").collect())) == [("A line.", "Zeile"), ("one", "eins")]


def test_glossary_and_segments(spark, tmp_path):
    entries = [{"source": "a", "target": "b"}, {"source": "c"}]
    (tmp_path / "list.json").write_text(json.dumps(entries))
    (tmp_path / "object.json").write_text(json.dumps({"entries": entries, "version": 2}))
    for name in ("list", "object"):
        assert [tuple(r) for r in files.read_glossary(spark, f"{tmp_path}/{name}.json", "source:string,target:string").collect()] == [(0, "a", "b"), (1, "c", None)]
    (tmp_path / "corpus.jsonl").write_text('{"source": "x", "n": 1}\n\n{"n": 2}\n{"source": "y"}\n')
    assert sorted(r["source"] for r in files.read_segments(spark, f"{tmp_path}/corpus.jsonl").collect()) == ["x", "y"]


def test_runs(spark, tmp_path):
    for arm, job in (("A", "j1"), ("B", "j2"), ("B", "old"), ("C", "j3")):
        folder = tmp_path / "runs" / arm / job
        folder.mkdir(parents=True)
        (folder / "state.json").write_text(json.dumps({"pairs": [{"source": job, "target": "t"}], "stage": "done"}))
    for arm, job in (("A", "j1"), ("B", "j2"), ("C", "gone")):
        (tmp_path / "runs" / arm / "run_meta.json").write_text(json.dumps({"job_id": job}))
    got = files.read_runs(spark, str(tmp_path), "stage string, pairs array<struct<source:string,target:string>>").collect()
    assert sorted((r["arm"], r["job"], r["stage"], r["pairs"][0]["source"]) for r in got) == [("A", "j1", "done", "j1"), ("B", "j2", "done", "j2")]


def test_sinks(spark, tmp_path):
    rows = [(2, "random", 7, "s, with\nlines", 'left "b"', "right", "B", False), (1, "long_dense", 5, "s", "x", "x", "A", True)]
    packet = spark.createDataFrame(rows, "packet_id int, category string, seg_idx int, source string, candidate_a string, candidate_b string, left string, identical boolean")
    files.write_packet(packet, str(tmp_path / "p"), "seg_idx")
    read = lambda name: spark.read.option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/p/{name}", header=True)
    shown = read("packet")
    assert "left" not in shown.columns and set(files.MARKS) <= set(shown.columns)
    assert sorted((r["packet_id"], r["source"], r["candidate_a"], r["identical"], r["reviewer_note"]) for r in shown.collect()) == [("1", "s", "x", "1", None), ("2", "s, with\nlines", 'left "b"', "0", None)]
    assert sorted((r["packet_id"], r["candidate_a_is_arm"], r["candidate_b_is_arm"]) for r in read("key").collect()) == [("1", "A", "B"), ("2", "B", "A")]
    files.write_csv(packet.select("packet_id"), str(tmp_path / "c"), columns=["note", "packet_id"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["note", "packet_id"]


def test_a_join_has_parts_in_proportion_to_its_table(spark):
    from glossweave.sources import derived

    df = spark.range(100).withColumnRenamed("id", "doc_id")
    assert derived.dealt(df, spark.range(0, 9, 1, 3), "doc_id").rdd.getNumPartitions() == 3 * derived.PARTS_OF_A_SPLIT
    small = df.repartition(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert derived.dealt(small, spark.range(0, 9, 1, 3), "doc_id") is small
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
