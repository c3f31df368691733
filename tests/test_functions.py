"""Python-backed functions, versions, and the keyed stream."""

from pyspark.sql import functions as F

from glossweave.functions import python as py
from glossweave.operators import versions
from glossweave.shipping import ship


def test_spans(spark):
    ship(spark)
    text = "The “quick” brown–fox jumps.  And runs."
    df = spark.createDataFrame([("“quick”", text), ('"quick"', text), ("brown-fox", text), ("jumps. And", text), ("absent", text), ("", text), (None, text)], "n string, t string")
    got = [r["s"] for r in df.select(py.find_span("n", "t").alias("s")).collect()]
    assert [(s["start"], s["end"]) for s in got] == [(4, 11), (4, 11), (12, 21), (22, 33), (None, None), (None, None), (None, None)]


def test_revisions(spark):
    df = spark.createDataFrame([("Ａ b", "a B", False), ("a, b", "a b.", False), ("Straße", "STRASSE", False), ("a b", "a c", True), (None, "", False)], "a string, b string, want boolean")
    assert not df.filter(py.meaningful_revision("a", "b") != F.col("want")).collect()
    row = spark.createDataFrame([("one two three", "one 2 three four")], "a string, b string").select(py.delta("a", "b").alias("d"), py.similarity("a", "b").alias("s")).first()
    assert [tuple(x) for x in row["d"]] == [("replace", "two", "2"), ("insert", "", "four")]
    assert 0 < row["s"] < 1


def test_answers(spark):
    rows = [('```json\n["a", "b"]\n```', 2, ["a", "b"]), ('Sure: [{"translation": "a"}, {"target": "b"}] ok', 2, ["a", "b"]), ('{"1": "a", "2": "b"}', 2, ["a", "b"]), ("1. a\n2) b", 2, ["a", "b"]), ("plain", 1, ["plain"]), ("plain", 2, None), ('["a"]', 2, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "t string, n int, want array<string>")
    assert [r["got"] for r in df.select(py.answers("t", "n").alias("got")).collect()] == [w for *_, w in rows]
    assert [r["j"] for r in spark.createDataFrame([("x {bad [1, 2] y",), ("none",)], "t string").select(py.tolerant_json("t").alias("j")).collect()] == ["[1, 2]", None]
    batch = spark.createDataFrame([(1, ["a\nb", "c"])], "key int, sources array<string>")
    assert versions.translate(batch, py.echo_model).first()["targets"] == ["[a b]", "[c]"]

    def broken(prompt):
        raise OSError

    assert versions.translate(batch, broken).first()["targets"] is None


def test_observations(spark, tmp_path):
    schema = "source string, target string, seg long"
    rows = [("Le", "x", 1), ("le", "y", 2), ("of", "z", 3), ("OF", "z", 4), ("new", "n", 5)]
    batch = {r["source"]: r["kind"] for r in versions.observe(spark.createDataFrame(rows, schema)).collect()}
    assert batch == {"le": "target_conflict", "of": "known_consistency", "new": "emergent_candidate"}
    path = str(tmp_path / "in")
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(path)
    found = versions.observe_stream(spark.readStream.schema(schema).parquet(path))
    start = lambda: found.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    start()
    spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(path)
    start()
    last = {r["source"]: r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()}
    assert last == batch


def test_units_tile(spark):
    segs = spark.createDataFrame([(1, k) for k in range(6)], "doc_id long, seg_idx int")
    sections = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 2, 3)], "doc_id long, section_id string, start_segment int, end_segment int")
    got = [tuple(r)[1:] for r in versions.semantic_units(segs, sections).orderBy("start_segment").collect()]
    assert got == [("unit-0001", None, 0, 0), ("unit-0002", "a", 1, 2), ("unit-0003", "b", 3, 3), ("unit-0004", None, 4, 5)]
