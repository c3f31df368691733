"""Importance resampling towards a target distribution, with hashed word n-grams as features.

A feature's bucket is the CRC-32 of its bytes modulo the buckets. All documents and all target texts are counted by bucket, in whole numbers;
a bucket's gain is the logarithm of its share among target features over that among the documents', one added to each count, in thousandths. A
document weighs the mean gain of its features, and Gumbel noise of its id is added: the highest scores are then a draw without replacement.

Each batch interns its n-grams in an open-addressed numpy table keyed by XXH64 and verified by bytes (see ``ngrams``): buckets are worked out
once for each slot, counts are summed over slots, and gains are gathered through the slots of all occurrences.

A task gives at most one count for each bucket, and the driver gets one gain for each, so both are bounded by the number of buckets. Ranks are places in Spark's
sorted ranges; no task sorts the whole.

Null and empty texts have no features, weigh 0 and aren't drawn. A null doc_id takes part in the noise as an empty string and comes last among ties; rows that repeat a
doc_id are scored and drawn each. Without target texts every bucket has a gain still, from counts of 0; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.common import in_parts, own_columns, ship, table, written
from glossweave.llm.ngrams import Ngrams
from glossweave.llm.sql import crc32, folded
from glossweave.operators.numbering import numbered

BUCKETS, MOST, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: Texts of one table of n-grams: so many rows and bytes, or one longer text.
ROWS, OCTETS = 2000, 1 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in in_parts(batches, "text", rows=ROWS, octets=OCTETS):
        yield batch, batch.column("text").cast(pa.binary()).to_pylist()


def _bucket_counts(buckets: int, most: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, texts in _texts(batches):
            grams = Ngrams(texts, most)
            slot, first = grams.interned()
            n = np.bincount(slot, minlength=len(first))
            total += np.bincount(grams.crc32(first) % np.uint32(buckets), weights=n, minlength=buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return counts


def bucket_counts(texts: DataFrame, *, text_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """How many features of all texts fall into each bucket; buckets without any have no row."""
    ship(texts.sparkSession)
    return own_columns(texts, text=text_col).mapInArrow(_bucket_counts(buckets, most), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> np.ndarray:
    """Each bucket's gain, in thousandths rounded down."""
    sides = [bucket_counts(df, text_col=c, buckets=buckets, most=most).withColumn("side", F.lit(k)) for k, (df, c) in enumerate(((docs, text_col), (target, target_text_col)))]
    n = np.zeros((2, buckets), dtype=np.int64)
    for r in sides[0].unionByName(sides[1]).collect():  # two rows for each bucket at most
        n[r["side"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = n.tolist(), n.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log(float((b + 1) * (all_s + buckets)) / float((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def _weighed(shared, buckets: int, most: int):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            grams = Ngrams(texts, most)
            slot, first = grams.interned()
            gain = shared.value[grams.crc32(first) % np.uint32(buckets)][slot]
            n = np.bincount(grams.of, minlength=len(texts))
            total = np.bincount(grams.of, weights=gain, minlength=len(texts)).astype(np.int64)  # exact: sums stay below 2^53
            weight = total // np.maximum(n, 1)
            found = [pa.array(x.astype(np.int64)) for x in (grams.words, n, weight)]
            yield pa.record_batch([batch.column("doc"), *found], names=["doc", "n_words", "n_features", "weight"])

    return weighed


def noise(doc: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, most: int = MOST, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of all documents; ``rank`` numbers those drawn: ``share`` per cent of the documents of ``least_words`` words and more."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gains(docs, target, text_col=text_col, target_text_col=target_text_col, buckets=buckets, most=most))
    own = own_columns(docs, doc=id_col, text=text_col)
    fields = ", ".join((f"doc {own.schema['doc'].dataType.simpleString()}", "n_words long", "n_features long", "weight long"))
    weighed = own.mapInArrow(_weighed(shared, buckets, most), fields)
    weighed = written(weighed)  # ranges are drawn from a first reading and filled by a second
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc"), seed)).withColumn("may", F.col("n_words") >= least_words)
    placed = numbered(scored, F.desc("may"), F.desc("score"), F.asc_nulls_last("doc"), F.desc("weight"), "n_features", name="place", keep=written)
    drawn = placed.agg(F.count_if("may").alias("n")).first()["n"] * share // 100
    return placed.select(F.col("doc").alias("doc_id"), "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH text AS (
  SELECT side, id, regexp_extract_all({folded("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
feature AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM text),
own AS (SELECT side, id, f, count(*) AS n FROM feature GROUP BY side, id, f),
bucket AS (SELECT f, ({crc32("f")} % {BUCKETS})::BIGINT AS b FROM (SELECT DISTINCT f FROM own)),
total AS (SELECT coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM own),
counted AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM own JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(((c.t + 1) * (a.s + {BUCKETS}))::DOUBLE / ((c.s + 1) * (a.t + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM counted c, total a),
weighed AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM own JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT x.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || x.id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM text x LEFT JOIN weighed USING (id) WHERE side = 0),
placed AS (
  SELECT doc_id, n_features, weight, score, n_words >= {LEAST_WORDS} AS may, row_number() OVER (ORDER BY n_words >= {LEAST_WORDS} DESC, score DESC, doc_id) AS place,
         (count(*) FILTER (n_words >= {LEAST_WORDS}) OVER ()) * {SHARE} // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
"""
