"""Corpus tables derived from the driver's tables: segments, translation pairs, glossary, sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.text import ORNAMENT

GLOSSARY_SCHEMA = "id string, source string, preferred string, forbidden array<string>, behavior string, status string, scope string, pos int"
GLOSSARY = [
    ("t1", "le", "het", ["la", "les"], "translate", "locked", "global", 0), ("t2", "of", "van", ["is"], "translate", "locked", "", 1), ("t3", "ouen", "the", ["ing"], "translate", "locked", "section:s1", 2),
    ("t4", "the", "that", ["thing", "thor"], "translate", "locked", "global", 3), ("t5", "worthless", "worthless", [], "preserve", "locked", "global", 4), ("t6", "de", "de", [], "preserve", "locked", "segment:0", 5),
    ("t7", "and", "und", ["et"], "translate", "provisional", "document", 6), ("t8", "OF", "von", [], "translate", "locked", "section:s0", 7), ("t9", "scum", "", [], "translate", "rejected", "global", 8),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it has fewer partitions than there are: a small file with one row group would be one task's work. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Parts of a join for each split of the table that its rows come from.
PARTS_OF_A_SPLIT = 8


def dealt(df: DataFrame, source: DataFrame, *keys: str, of_a_split: int = PARTS_OF_A_SPLIT) -> DataFrame:
    """``df`` by its keys in parts that grow in number with the table ``source`` that it comes from, so that a task's share of a join or a window stays as it is. Where Spark's number of shuffle partitions is
    enough for that, it is left to Spark."""
    parts = of_a_split * source.rdd.getNumPartitions()
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def gathered(source: DataFrame) -> Callable[..., DataFrame]:
    """Always deals by the keys, so that all groups and joins by them that follow need no shuffle: in parts that grow with ``source``, or in Spark's number of them."""

    def deal(df: DataFrame, *keys: str) -> DataFrame:
        parts = dealt(df, source, *keys, of_a_split=2)
        return df.repartition(*keys) if parts is df else parts

    return deal


def dealt_by(source: DataFrame) -> Callable[..., DataFrame]:
    """``dealt`` with its source, as operators take it that join often: with fewer and larger parts, as each costs every join a task."""
    return lambda df, *keys: dealt(df, source, *keys, of_a_split=2)


def segments(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", last: str | None = None, deal: Callable[..., DataFrame] | None = None) -> DataFrame:
    """One row per paragraph: lines without spaces at their ends, longer than a character, no ornaments, numbered anew. A column ``last``, if named, says whether a row is its document's last. Documents are
    spread, or dealt by their id."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & ~x.rlike(ORNAMENT))
    own = docs.select(id_col, text_col)
    own = deal(own, id_col) if deal else spread(own)
    if not last:
        return own.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("seg_idx", "text"))
    each = own.select(F.col(id_col).alias("doc_id"), lines.alias("__lines")).select("doc_id", F.size("__lines").alias("__n"), F.posexplode("__lines").alias("seg_idx", "text"))
    return each.select("doc_id", "seg_idx", "text", (F.col("seg_idx") == F.col("__n") - 1).alias(last))


def pairs(conversations: DataFrame, *, deal: Callable[..., DataFrame] | None = None) -> DataFrame:
    """A user's turn and the assistant's next as source and target. Arms are dealt by conversation."""
    user = conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("seg_idx"), F.col("text").alias("source"))
    answer = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("seg_idx"), F.col("text").alias("target"))
    arm = F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B").alias("arm")
    user = deal(user, "conv_id", "seg_idx") if deal else user
    return user.join(answer, ["conv_id", "seg_idx"]).select("conv_id", "seg_idx", arm, "source", "target")


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, GLOSSARY_SCHEMA)


#: Of a word that occurs n times as it is written: its entry. SQL that Spark and DuckDB read alike, but for the list.
WORD_ENTRY = {
    "id": "'w-' || term", "source": "term", "preferred": "CASE WHEN n % 2 = 0 THEN 'r-' || lower(term) ELSE 'R-' || term END", "behavior": "CASE WHEN n % 4 = 0 THEN 'preserve' ELSE 'translate' END",
    "status": "CASE n % 5 WHEN 0 THEN 'locked' WHEN 1 THEN 'provisional' WHEN 2 THEN 'rejected' WHEN 3 THEN ' Locked ' ELSE 'odd' END", "scope": "CASE WHEN n % 3 = 0 THEN 'global' ELSE 'section:s' || (n % 7) END", "pos": "n",
}
_WORDS = "[A-Za-z]{6,}"
WORD_GLOSSARY_SQL = f"g AS (SELECT {', '.join(f'{x} AS {name}' for name, x in WORD_ENTRY.items())}, CASE WHEN n % 3 = 0 THEN ['x' || n, 'no-' || term] ELSE []::VARCHAR[] END AS forbidden FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORDS}')) AS term FROM documents) GROUP BY term))"


def word_glossary(docs: DataFrame) -> DataFrame:
    """A glossary of all words of some length, as they are written, with fields by how often they occur."""
    n = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    forbidden = F.when(F.col("n") % 3 == 0, F.array(F.concat(F.lit("x"), "n"), F.concat(F.lit("no-"), "term"))).otherwise(F.array().cast("array<string>"))
    return n.withColumn("forbidden", forbidden).selectExpr(*[f"{x} AS {name}" for name, x in WORD_ENTRY.items()], "forbidden")


def sections(segs: DataFrame, *, size: int = 10) -> DataFrame:
    """Ranges of ``size`` segments of each document."""
    last = segs.groupBy("doc_id").agg(F.max("seg_idx").alias("last"))
    each = last.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / size))).alias("n"))
    return each.select("doc_id", F.concat(F.lit("s"), "n").alias("section_id"), (F.col("n") * size).cast("int").alias("start_segment"), (F.col("n") * size + size - 1).cast("int").alias("end_segment"))
