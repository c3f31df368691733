"""Statistics of divisions of a text that changed: one pass over documents that are dealt once."""

import re

import duckdb

import __spark_entry__  # noqa: F401  it loads all that add to the catalogue
from glossweave.operators import alignment
from glossweave.plans.catalogue import QUERIES, SQL

NAME = "stream_align_statistics"
COLUMNS = ["doc_id", "old_total", "skipped_suspect", "not_found", "new_total", "reused"]
LINES = "It’s the first…|A second – one|* * *|THIRD paragraph “here”|It’s the first…|x|  fifth\tone  |Sixth. And more. And still more.|7th|eighth|ninth|tenth|Straße|twelfth|13th|14th|15th|16th|17th|18th|19th|20th".split("|")


def _documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_are_shuffled_once(spark, tmp_path):
    d = _documents(spark, tmp_path, [(k, "\n".join(LINES[k % 7 :] * 2)) for k in range(40)])
    df = QUERIES[NAME](spark, d)
    assert len(df.collect()) == 40
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"\+- Exchange ", plan)) == 1 and "ReusedExchange" in plan, plan


def test_odd_documents_as_in_sql(spark, tmp_path):
    """Without text or paragraphs, without an id, and one that stands there twice."""
    rows = [(k, "\n".join((LINES[k:] + LINES[:k]) * (1 + k % 3))) for k in range(len(LINES))]
    rows += [(100, None), (101, ""), (102, "\n \n-\n"), (103, "a"), (104, "ab"), (None, "\n".join(LINES)), (None, "one line"), (105, "\n".join(LINES)), (105, "\n".join(LINES))]
    d = _documents(spark, tmp_path, rows)
    got = QUERIES[NAME](spark, d).select(*COLUMNS).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({SQL[NAME]})").fetchall()
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_sides_alone(spark):
    old = spark.createDataFrame([(1, 0, "One", "Un"), (1, 1, "Two", None), (1, 2, " ", "x"), (1, 3, "gone", "parti"), (2, 0, "Alone", "Seul")], "doc_id long, seg_idx int, source string, target string")
    new = spark.createDataFrame([(1, 0, "one"), (1, 1, "two"), (3, 0, "New"), (3, 1, None)], "doc_id long, new_idx int, text string")
    got = {tuple(r) for r in alignment.alignment_statistics(old, new).select(*COLUMNS).collect()}
    assert got == {(1, 4, 1, 1, 2, 1), (2, 1, 0, 1, 0, 0), (3, 0, 0, 0, 2, 0)}
