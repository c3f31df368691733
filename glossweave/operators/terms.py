"""Joins of a glossary with texts, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import strip, term_matches
from glossweave.operators.matching import SHARD_CHARS, term_matches_in

#: Beyond ASCII, what folds to an ASCII letter, and that letter.
_ODD, _EVEN = "\u0130\u0131\u017f\u212a", "iisk"


def occurrences(segments: DataFrame, terms: DataFrame, *, few_chars: int = SHARD_CHARS) -> DataFrame:
    """Per term: how many segments and documents hold it, and the first segment number.

    Of more than ``few_chars`` of terms those that are one word are joined with the counts of all words, so that texts are read once however many terms there are."""
    own = terms.select("id", F.col("source").alias("term"))
    single = F.coalesce(F.trim("term").rlike(r"^[A-Za-z0-9_]+\z"), F.lit(False))
    size = own.agg(F.coalesce(F.sum(F.length("term") + 1), F.lit(0)).alias("chars"), F.min(F.when(single, F.length(F.trim("term")))).alias("least")).first()
    if size["chars"] <= few_chars or size["least"] is None:
        return _counted(segments, own)
    folded = F.lower(F.translate("text", _ODD, _EVEN))
    held = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"[a-z0-9_]{{{size['least']},}}"), F.lit(0)))
    by_document = segments.select("doc_id", "seg_idx", F.explode(held).alias("word")).groupBy("word", "doc_id").agg(F.count("*").alias("n"), F.min("seg_idx").alias("first"))
    counts = by_document.groupBy("word").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"), F.min("first").alias("first"))
    met = own.filter(single).withColumn("word", F.lower(F.trim("term"))).join(counts, "word")
    words = met.groupBy("id", "term").agg(F.sum("n").alias("n_segments"), F.max("docs").alias("n_docs"), F.min("first").alias("first_seg"))
    return words.unionByName(_counted(segments, own.filter(~single)))


def _counted(segments: DataFrame, terms: DataFrame) -> DataFrame:
    hits = term_matches_in(segments, terms, term_col="term", keep=["doc_id", "seg_idx"])
    return hits.groupBy("id", "term").agg(F.count("*").alias("n_segments"), F.countDistinct("doc_id").alias("n_docs"), F.min("seg_idx").alias("first_seg"))


def _forbidden_hit(target: str = "target") -> Column:
    return F.exists("forbidden", lambda f: F.contains(F.col(target), f))


def adoption(pairs: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """Per locked term (and ``keys``): occurrences, adopted, rate, forbidden violations and preserve failures.

    A segment counts once however many forbidden forms it has; forbidden forms are plain substrings, preferred ones terms."""
    hits = term_matches_in(pairs, terms.filter("status = 'locked'"), text_col="source", term_col="term_source", keep=[*keys, "target"])
    kept = F.when(F.col("behavior") == "preserve", F.contains("target", "term_source")).otherwise(term_matches(F.col("preferred"), F.col("target")))
    n = F.count("*")
    adopted = F.sum(kept.cast("long"))
    return hits.groupBy(*keys, "id").agg(
        n.alias("occurrences"), adopted.alias("adopted"), F.round(adopted / n, 4).alias("rate"),
        F.sum(((F.col("behavior") != "preserve") & _forbidden_hit()).cast("long")).alias("forbidden_violations"), F.sum(((F.col("behavior") == "preserve") & ~kept).cast("long")).alias("preserve_failures"),
    )


def usage_conflicts(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every use of a locked term that is rendered in more than one way: preferred, a forbidden form, or another."""
    hits = term_matches_in(pairs, terms.filter("status = 'locked' AND behavior = 'translate'"), text_col="source", term_col="term_source", keep=["conv_id", "seg_idx", "target"])
    first = F.filter("forbidden", lambda f: F.contains(F.col("target"), f))
    usage = F.when(term_matches(F.col("preferred"), F.col("target")), F.col("preferred")).when(F.size(first) > 0, F.element_at(first, 1)).otherwise("(other)")
    used = hits.withColumn("usage", usage)
    several = used.groupBy("id").agg(F.min("usage").alias("lo"), F.max("usage").alias("hi")).filter("lo <> hi").select("id")
    return used.join(several, "id").select("id", "conv_id", "seg_idx", "usage")


def in_scope(scope: Column, segment: Column, section: Column) -> Column:
    value = F.split_part(scope, F.lit(":"), F.lit(2))
    return F.when(scope.isin("", "global", "document"), F.lit(True)).when(scope.startswith("section:"), value == section).when(scope.startswith("segment:"), value == segment.cast("string")).otherwise(F.lit(False))


def select_for_batches(segments: DataFrame, terms: DataFrame, *, provisional_cap: int = 5, batch: int = 4) -> DataFrame:
    """Per batch of segments: terms in it whose scope fits, rejected ones never, provisional ones up to a cap in their order.

    ``segment:`` scopes count within the batch, ``section:`` scopes are ranges of ten segments."""
    own = segments.select("doc_id", "seg_idx", "text", F.floor(F.col("seg_idx") / batch).cast("int").alias("batch"))
    hits = term_matches_in(own, terms.filter("status <> 'rejected'"), keep=["doc_id", "seg_idx", "batch"])
    section = F.concat(F.lit("s"), F.floor(F.col("seg_idx") / 10))
    fit = hits.filter(in_scope(F.col("scope"), F.col("seg_idx") % batch, section)).select("doc_id", "batch", "id", "status", "pos").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id", "batch", "status").orderBy("pos"))
    return fit.withColumn("n", n).filter(f"status <> 'provisional' OR n <= {provisional_cap}").select("doc_id", "batch", "id")


def audit(segments: DataFrame, terms: DataFrame, *, snippets: int = 3, width: int = 60) -> DataFrame:
    """Per term: occurrences and the first contexts, clipped."""
    hits = term_matches_in(segments.withColumn("clip", F.substring("text", 1, width)), terms.select("id", F.col("source").alias("term")), term_col="term", keep=["doc_id", "seg_idx", "clip"])
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("doc_id", "seg_idx"))).filter(F.col("n") <= snippets)
    clips = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "clip"))), lambda x: x["clip"]), " || ").alias("snippets"))
    return hits.groupBy("id").agg(F.count("*").alias("occurrences")).join(clips, "id")


def self_conflicts(terms: DataFrame) -> DataFrame:
    """Rows whose source, whatever its case, has more than one preferred form."""
    key = F.lower("source")
    many = terms.groupBy(key.alias("k")).agg(F.countDistinct("preferred").alias("n")).filter("n > 1").select("k")
    return terms.join(many, key == F.col("k"), "left_semi").select("id", "source", "preferred")


def set_hash(terms: DataFrame) -> DataFrame:
    """One hash of the whole glossary that doesn't depend on the order of its rows or forbidden forms: of the hashes of 4,096 buckets, each of
    the sorted hashes of its rows, so that no task holds all rows."""
    row = F.concat_ws("|", "source", "preferred", F.array_join(F.array_sort("forbidden"), ","), "behavior", "status", "scope")
    rows = terms.select(F.sha2(row, 256).alias("row"))
    joined = lambda c: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(c))), 256)
    buckets = rows.groupBy(F.substring("row", 1, 3).alias("bucket")).agg(joined("row").alias("hash"), F.count("*").alias("n"))
    by_bucket = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"])
    return buckets.agg(F.sha2(F.concat_ws("\n", by_bucket), 256).alias("glossary_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))


def normalized(terms: DataFrame) -> DataFrame:
    """Defaults, known values only, and an id from source, preferred form and behavior."""
    behavior = F.lower(strip(F.coalesce("behavior", F.lit(""))))
    status = F.lower(strip(F.coalesce("status", F.lit(""))))
    behavior = F.when(behavior.isin("translate", "preserve"), behavior).otherwise("translate")
    status = F.when(status.isin("locked", "provisional", "rejected"), status).otherwise("provisional")
    source = strip(F.coalesce("source", F.lit("")))
    target = strip(F.coalesce("preferred", F.lit("")))
    made = F.concat(F.lit("t-"), F.substring(F.sha2(F.concat_ws("|", F.lower(source), F.lower(target), behavior), 256), 1, 12))
    return terms.filter(source != "").select(made.alias("entry_id"), source.alias("source"), target.alias("target"), behavior.alias("behavior"), status.alias("status"))
