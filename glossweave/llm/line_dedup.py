"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages that hold it over all pages of the
host; lines at or beyond ``ratio`` that stand on ``min_pages`` pages at least are boilerplate and are dropped.

The corpus pipeline's stage is stricter where the evidence is larger, and copies are no evidence: with ``once`` each
distinct page text counts once for its host, in a line's pages and in all pages, and with ``wide`` = (ratio, pages) lines
that stand on so many pages are dropped at that lower ratio.

Lines end at a newline and are compared without spaces at their ends; blank lines are neither counted nor
dropped. A line that repeats within a page counts once for it. A null host is a host of its own. Null texts stay
null, a page whose lines all go keeps its row with an empty text. Lines are counted by a 128-bit key, so the
count never moves their text. Counts are summed before the shuffle, so a host or line with a third of all rows is
one row per task; a host has at most (lines per page) / (the lower ratio) boilerplate lines, which bounds the array that
is joined back. The array is broadcast if
the lines were counted to be few; beyond that the join is left to Spark, which splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import table, written

RATIO, MIN_PAGES = 0.1, 3
#: Measured on sf0.1, by distinct pages of a source: one line on 8.6 to 13.2 %, nine more on 1.0 to 4.6 %, and licences and chance below.
WIDE = (0.02, 10)
#: At 16 bytes each, and the hosts' names, 4 MB or so are broadcast.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def host_of(url: Column) -> Column:
    """The host of a page's address, without case and a leading www; null if there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def boilerplate(pages: DataFrame, *, host: Column, text: Column, ratio: float, min_pages: int, once: bool = False, wide: tuple[float, int] | None = None) -> DataFrame:
    """Per host: the keys of its boilerplate lines."""
    own = pages.select(F.coalesce(F.concat(F.lit("h"), host), F.lit("")).alias("host"), text.alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.array_distinct(F.transform(lines, _key))
    if once:
        page = _key(F.col("text")).alias("page")
        each = own.select("host", page, keys.alias("lines")).distinct().select("host", F.explode("lines").alias("line"))
        total = own.select("host", page).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    else:
        each = own.select("host", F.explode(keys).alias("line"))
        total = own.groupBy("host").agg(F.count("*").alias("pages"))
    enough = ratio * F.col("pages")
    if wide:
        enough = F.least(enough, F.greatest(wide[0] * F.col("pages"), F.lit(wide[1])))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counts.join(total, "host").filter(F.col("n") >= enough).groupBy("host").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate_lines(pages: DataFrame, *, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_as: tuple[str, str] | None = None, once: bool = False, wide: tuple[float, int] | None = None) -> DataFrame:
    """``pages`` with its columns and less text. ``count_as``: names of two more columns, for the lines before and the lines dropped."""
    found = boilerplate(pages, host=host, text=F.col(text_col), ratio=ratio, min_pages=min_pages, once=once, wide=wide)
    found = written(found.select(F.struct("host", "drop").alias("__boilerplate")))
    if (found.agg(F.sum(F.size("__boilerplate.drop") + 1).alias("n")).first()["n"] or 0) <= BROADCAST_LINES:
        found = F.broadcast(found)
    key = F.coalesce(F.concat(F.lit("h"), host), F.lit(""))
    whole = pages.withColumn("__host", key).join(found, F.col("__host") == F.col("__boilerplate.host"), "left")
    keep = F.filter(F.split(text_col, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("__boilerplate.drop"), _key(F.trim(x))), F.lit(False)))
    text = F.when(F.col("__boilerplate").isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in pages.columns]
    if count_as:
        before = F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long")
        before = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(before)
        after = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(keep)).cast("long")
        columns += [before.alias(count_as[0]), (before - after).alias(count_as[1])]
    return whole.select(*columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs, host=F.col("source"), count_as=("n_lines", "n_dropped")).drop("source")


OP5_SQL = f"""
WITH page AS (SELECT doc_id, coalesce('h' || source, '') AS host, string_split(text, chr(10)) AS lines FROM documents),
each_line AS (SELECT DISTINCT host, doc_id, trim(line, ' ') AS line FROM (SELECT host, doc_id, unnest(lines) AS line FROM page)),
total AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
bad AS (
  SELECT host, list(line) AS dropped FROM (
    SELECT host, line, count(*) AS n, any_value(pages) AS pages FROM each_line JOIN total USING (host) WHERE line <> '' GROUP BY host, line)
  WHERE n >= {MIN_PAGES} AND n >= {RATIO} * pages GROUP BY host),
kept AS (
  SELECT doc_id, lines, CASE WHEN bad.host IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(dropped, trim(x, ' '))) END AS rest
  FROM page LEFT JOIN bad USING (host))
SELECT doc_id, array_to_string(rest, chr(10)) AS text, coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(len(rest), 0))::BIGINT AS n_dropped FROM kept
"""
