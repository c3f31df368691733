"""Translation memory, interval and as-of joins, staleness and delivery state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import incomplete, memory_eligible, term_matches
from glossweave.operators.matching import term_matches_in


def _key(text: str) -> Column:
    """What a memory is looked up by: the text in one line, hashed."""
    return F.sha2(F.regexp_replace(text, "\n", " "), 256).alias("source_key")


def memory_of(docs: DataFrame) -> DataFrame:
    """A memory of the texts that stand in several documents, by their hash; the least document's id is the target."""
    own = docs.select("doc_id", F.sha2("text", 256).alias("whole"), _key("text"))
    return own.groupBy("whole", "source_key").agg(F.min("doc_id").alias("target_id"), F.count("*").alias("n")).filter("n > 1").groupBy("source_key").agg(F.min("target_id").alias("target_id"))


def lookup(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Exact hits, passages without a word character that pass through, and the rest."""
    own = segments.withColumn("plain", ~F.col("text").rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]")).withColumn("source_key", _key("text")).drop("text")  # only hashes are shuffled
    found = own.join(memory, "source_key", "left")
    kind = F.when(F.col("target_id").isNotNull(), "memory").when(F.col("plain"), "passthrough").otherwise("translate")
    return found.withColumn("route", kind).drop("source_key", "plain")


def insert_if_absent(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """``memory`` (source, target) and of ``rows`` the eligible ones whose source it lacks, the first for each source."""
    fit = rows.filter(memory_eligible(F.col("source"), F.col("target"))).groupBy("source").agg(F.min_by("target", "pos").alias("target"))
    return memory.select("source", "target").unionByName(fit.join(memory, "source", "left_anti").select("source", "target"))


def compatibility(rows: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """Class of each remembered pair under the glossary: incompatible over scope_sensitive over ambiguous over compatible; unaffected without a term."""
    hits = term_matches_in(rows, terms.filter("status <> 'rejected'"), text_col="source", term_col="term_source", keep=[*keys, "target"])
    forbidden = F.exists("forbidden", lambda f: F.contains(F.col("target"), f))
    good = F.when(F.col("behavior") == "preserve", F.contains("target", "term_source")).otherwise(term_matches(F.col("preferred"), F.col("target")))
    rank = F.when(forbidden, 4).when(~F.col("scope").isin("", "global"), 3).when(good, 1).when(F.col("status") == "locked", 4).otherwise(2)
    worst = hits.groupBy(*keys).agg(F.max(rank).alias("rank"), F.count("*").alias("terms"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("unaffected", "compatible", "ambiguous", "scope_sensitive", "incompatible")]), F.coalesce("rank", F.lit(0)) + 1)
    return rows.select(*keys).join(worst, list(keys), "left").select(*keys, names.alias("class"), F.coalesce("terms", F.lit(0)).alias("terms"))


def audit_statistics(rows: DataFrame) -> DataFrame:
    """rows(class, terms), terms being the sources met, joined by " | ": rows, those of each class, those that any term affects, and the incompatible share of these."""
    n = lambda name: F.count_if(F.col("class") == name).alias(name)
    affected = F.count_if(F.col("class") != "unaffected")
    counts = [n(x) for x in ("unaffected", "compatible", "incompatible", "ambiguous", "scope_sensitive")]
    return rows.agg(F.count("*").alias("total"), affected.alias("affected"), *counts, F.round(F.count_if(F.col("class") == "incompatible") / F.greatest(affected, F.lit(1)), 4).alias("incompatible_rate"))


def conflicting_terms(rows: DataFrame, *, most: int = 20) -> DataFrame:
    """Of rows(class, matched, pos), matched being an array of sources: the terms that most incompatible rows hold, those met first before others of as many, and how many rows of any class name each in their sources joined by " | ", inside others too."""
    hit = rows.filter("class = 'incompatible'").select("pos", F.posexplode("matched").alias("k", "term")).filter("term <> ''")
    top = hit.groupBy("term").agg(F.count("*").alias("incompatible"), F.min(F.struct("pos", "k")).alias("first")).orderBy(F.desc("incompatible"), "first").limit(most).select("term", "incompatible").collect()
    if not top:
        return rows.sparkSession.createDataFrame([], "term string, incompatible long, mentioning long")
    # one pass over all rows for the terms of the report
    joined = F.array_join("matched", " | ")
    each = rows.agg(*[F.count_if(F.contains(joined, F.lit(r["term"]))).alias(f"m{k}") for k, r in enumerate(top)])
    listed = F.array(*[F.struct(F.lit(r["term"]).alias("term"), F.lit(r["incompatible"]).cast("long").alias("incompatible"), F.col(f"m{k}").alias("mentioning")) for k, r in enumerate(top)])
    return each.select(F.inline(listed))


def health(memory: DataFrame) -> DataFrame:
    """Of a memory (source, target, reviewed): its rows, those that may be trusted (reviewed, and fit to be kept), those of them that look incomplete, and whether it can be used."""
    trusted = memory.filter(F.coalesce("reviewed", F.lit(False)) & memory_eligible(F.col("source"), F.col("target")))
    cut = F.count_if(incomplete(F.col("source"), F.col("target")))
    raw = memory.agg(F.count("*").alias("raw_entries"))
    own = trusted.agg(F.count("*").alias("trusted"), cut.alias("incomplete_in_trusted"), (cut == 0).alias("usable"))
    return raw.withColumn("one", F.lit(1)).join(own.withColumn("one", F.lit(1)), "one").drop("one")


def to_sections(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section, by its start, that holds each segment. Sections are an interval table of the same document."""
    met = segments.select("doc_id", "seg_idx").alias("g").join(sections.alias("s"), F.expr("g.doc_id = s.doc_id AND s.start_segment <= g.seg_idx AND g.seg_idx <= s.end_segment"), "left")
    met = met.select("g.doc_id", "g.seg_idx", "s.section_id", "s.start_segment")
    return met.groupBy("doc_id", "seg_idx").agg(F.min_by("section_id", "start_segment").alias("section_id"))


def earlier_targets(pairs: DataFrame, *, limit: int = 2, chars: int = 1200) -> DataFrame:
    """As of each pair, the last targets of its conversation before it, in their order, whatever their provenance."""
    w = Window.partitionBy("conv_id").orderBy("seg_idx").rowsBetween(-limit, -1)
    return pairs.select("conv_id", "seg_idx", F.array_join(F.collect_list(F.substring("target", 1, chars)).over(w), " || ").alias("context"))


def stream_length(text: str = "text") -> Column:
    """Characters that a text adds to the stream that two divisions of a document are aligned by."""
    return F.length(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "")))


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments (doc_id, seg_idx, n) of two divisions of the same stream of ``stream_length`` characters, joined where their ranges overlap.

    Ranges are prefix sums within a document; old segments are spread over blocks of the stream so that the interval
    join is an equi-join on blocks."""
    block = 512

    def ranged(df: DataFrame, idx: str) -> DataFrame:
        end = F.sum("n").over(Window.partitionBy("doc_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0))
        return df.select("doc_id", F.col("seg_idx").alias(idx), (end - F.col("n")).alias(f"{idx}_from"), end.alias(f"{idx}_to")).filter(F.col(f"{idx}_to") > F.col(f"{idx}_from"))

    spread = lambda df, i: df.withColumn("block", F.explode(F.sequence(F.floor(F.col(f"{i}_from") / block), F.floor((F.col(f"{i}_to") - 1) / block))))
    a, b = spread(ranged(old, "o"), "o"), spread(ranged(new, "n"), "n")
    met = a.join(b, ["doc_id", "block"]).filter("o_from < n_to AND n_from < o_to")
    return met.groupBy("doc_id", "n").agg(F.countDistinct("o").alias("n_old"), F.min("o").alias("first_old"), F.max(((F.col("o_from") == F.col("n_from")) & (F.col("o_to") == F.col("n_to"))).cast("int")).alias("reusable"))


def stale(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs whose source holds a term that a glossary change touched: its preferred or forbidden forms, behavior or status differ, or it came or went."""
    row = lambda df: df.select(F.lower("source").alias("k"), F.concat_ws("|", "preferred", F.array_join(F.array_sort("forbidden"), ","), "behavior", "status").alias("state"))
    a = row(before).groupBy("k").agg(F.max("state").alias("a"))
    b = row(after).groupBy("k").agg(F.max("state").alias("b"))
    changed = a.join(b, "k", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("k").alias("changed_term"))
    hits = term_matches_in(pairs, changed, text_col="source", term_col="changed_term", keep=["arm", "conv_id", "seg_idx"])
    return hits.groupBy("arm", "conv_id", "seg_idx").agg(F.array_join(F.array_sort(F.collect_set("changed_term")), ",").alias("terms"))


def delivery_status(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per conversation: blocked, needs_review or ready, by the worst open finding."""
    worst = findings.groupBy("conv_id").agg(F.max(F.when(F.col("severity") == "blocking", 2).when(F.col("severity") == "actionable", 1).otherwise(0)).alias("worst"), F.count("*").alias("n_findings"))
    state = F.when(F.col("worst") == 2, "blocked").when(F.col("worst") == 1, "needs_review").otherwise("ready")
    return pairs.select("conv_id").distinct().join(worst, "conv_id", "left").select("conv_id", state.alias("status"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
