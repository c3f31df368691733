"""Versioned glossaries, observed knowledge, units that tile a document, and case selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.python import answers, model_call
from glossweave.operators.numbering import numbered


def freeze(snapshots: DataFrame) -> DataFrame:
    """Of a job's snapshots (job, n, glossary_hash), in the order of ``n``, those that differ from the one before, with the version that each makes.

    Rows are numbered over the whole table: the one before is found by its number, and a version is the distance from its job's first. No job is one task's work, however long."""
    placed = numbered(snapshots.select("job", "n", "glossary_hash"), "job", "n", name="place")
    before = placed.select("job", (F.col("place") + 1).alias("place"), F.col("glossary_hash").alias("before"))
    changed = placed.join(before, ["job", "place"], "left").filter("before IS NULL OR before <> glossary_hash").select("job", "n", "glossary_hash")
    kept = numbered(changed, "job", "n", name="place")
    first = kept.groupBy("job").agg(F.min("place").alias("first"))
    return kept.join(first, "job").select("job", (F.col("place") - F.col("first") + 1).alias("version"), "n", "glossary_hash")


def entry_used(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """For each pair, the entry of the glossary version it was made with, and the newest entry of that source.

    pairs(conv_id, seg_idx, hash_used, entry_id); entries(glossary_hash, version, id, source, preferred, pos). Of entries with one
    id in a version the last holds."""
    last = entries.groupBy("glossary_hash", "id").agg(F.max_by(F.struct("source", "preferred"), "pos").alias("e"))
    used = last.select(F.col("glossary_hash").alias("hash_used"), F.col("id").alias("entry_id"), F.col("e.source").alias("source"), F.col("e.preferred").alias("used"))
    newest = entries.groupBy(F.lower("source").alias("k")).agg(F.max_by("preferred", F.struct("version", "pos")).alias("now"))
    met = pairs.join(used, ["hash_used", "entry_id"], "left").join(newest, F.lower("source") == F.col("k"), "left")
    return met.select("conv_id", "seg_idx", "entry_id", "used", "now", (~F.col("used").eqNullSafe(F.col("now"))).alias("changed"))


def observe(observations: DataFrame) -> DataFrame:
    """Per source, whatever its case: what its targets say. (source, target, seg) in; conflict, known or emergent out."""
    each = observations.groupBy(F.lower("source").alias("source")).agg(F.countDistinct("target").alias("n_targets"), F.count("*").alias("n"), F.min("seg").alias("first_seg"), F.min_by("target", "seg").alias("target"))
    return each.withColumn("kind", F.when(F.col("n_targets") > 1, "target_conflict").when(F.col("n") > 1, "known_consistency").otherwise("emergent_candidate"))


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    first, n, conflict = state.get if state.exists else (None, 0, False)
    for rows in batches:
        for target in rows.sort_values("seg")["target"]:
            first = target if first is None else first
            conflict = conflict or target != first
            n += 1
    state.update((first, n, conflict))
    kind = "target_conflict" if conflict else "known_consistency" if n > 1 else "emergent_candidate"
    yield pd.DataFrame({"source": [key[0]], "target": [first], "n": [n], "kind": [kind]})


def observe_stream(observations: DataFrame) -> DataFrame:
    """The same as a stream: a small state for each source, an event whenever it is seen."""
    keyed = observations.select(F.lower("source").alias("source"), "target", "seg").groupBy("source")
    return keyed.applyInPandasWithState(_track, "source string, target string, n long, kind string", "first string, n long, conflict boolean", "update", "NoTimeout")


def semantic_units(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """Units that tile each document: its sections, the first by start where they overlap, and the gaps between them.

    sections(doc_id, section_id, start_segment, end_segment)."""
    hit = segments.alias("g").join(sections.alias("s"), F.expr("g.doc_id = s.doc_id AND g.seg_idx BETWEEN s.start_segment AND s.end_segment"), "left")
    own = hit.groupBy("g.doc_id", "g.seg_idx").agg(F.min_by("s.section_id", F.struct("s.start_segment", "s.section_id")).alias("section_id"))
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    start = F.when(F.lag("section_id").over(w).eqNullSafe(F.col("section_id")) & (F.col("seg_idx") > 0), 0).otherwise(1)
    unit = F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("unit", unit).groupBy("doc_id", "unit").agg(F.first("section_id").alias("section_id"), F.min("seg_idx").alias("start_segment"), F.max("seg_idx").alias("end_segment")).select(
        "doc_id", F.format_string("unit-%04d", "unit").alias("unit_id"), "section_id", "start_segment", "end_segment"
    )


def headed_blocks(lines: DataFrame, *, heading: str) -> DataFrame:
    """Blocks of lines between blank ones, each with the last heading before it. (doc_id, line_no, line) in."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    blank, head = F.trim("line") == "", F.col("line").rlike(heading)
    marked = lines.withColumn("block", F.sum((blank | head).cast("int")).over(w)).withColumn("heading", F.last(F.when(head, F.trim("line")), ignorenulls=True).over(w))
    return marked.filter(~blank & ~head).groupBy("doc_id", "block").agg(F.first("heading").alias("heading"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.sum(F.length("line")).alias("chars")).drop("block")


def diverse(cases: DataFrame, *, most: int = 12) -> DataFrame:
    """The best case of each category first, then the best of the rest. (case_id, category, score) in."""
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "case_id"))
    return cases.withColumn("late", (n > 1).cast("int")).orderBy("late", F.desc("score"), "case_id").limit(most).select("case_id", "category", "score")


def place_cases(cases: DataFrame, sections: DataFrame) -> DataFrame:
    """Each case's section: the one whose claims overlap its own most, the first of equals. (case_id, claims), (section_id, pos, claims) in."""
    a = cases.select("case_id", F.explode("claims").alias("claim"))
    b = sections.select("section_id", "pos", F.explode("claims").alias("claim"))
    n = a.join(b, "claim").groupBy("case_id", "section_id", "pos").agg(F.count("*").alias("n"))
    return n.groupBy("case_id").agg(F.max_by("section_id", F.struct("n", (-F.col("pos")).alias("p"))).alias("section_id"), F.max("n").alias("overlap"))


def manifest(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counts over a delivery and its open findings."""
    a = pairs.agg(F.count("*").alias("segments"), F.sum(F.length("source")).alias("source_chars"), F.sum(F.length("target")).alias("target_chars"), F.countDistinct("conv_id").alias("documents"))
    by = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0)).alias(s)
    b = findings.agg(by("blocking"), by("actionable"), by("informational"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def translate(batches: DataFrame, call) -> DataFrame:
    """(key, sources) to (key, targets) through an injected model: numbered prompt, call, tolerant reading; null if any is missing."""
    numbered = F.array_join(F.transform("sources", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.regexp_replace(x, r"\n", " "))), "\n")
    asked = batches.withColumn("answer", model_call(call)(F.concat(F.lit("Translate each line.\n"), numbered)))
    return asked.withColumn("targets", answers(F.col("answer"), F.size("sources"))).drop("answer")


def report_violations(sections: DataFrame, segments: DataFrame, statistics: DataFrame) -> DataFrame:
    """Markers in a report's sections against what is stored.

    ``[[seg:DOC:IDX|QUOTE]]`` must name a segment and quote it, white space apart; ``{{STAT:KEY=VALUE}}`` must name a statistic and
    give its value, commas apart. sections(section_id, body), segments(doc_id, seg_idx, text), statistics(key, value)."""
    seg = sections.select("section_id", F.explode(F.regexp_extract_all("body", F.lit(r"\[\[seg:(\d+:\d+\|[^\]]*)\]\]"), F.lit(1))).alias("m"))
    at = F.split_part("m", F.lit("|"), F.lit(1))
    seg = seg.select("section_id", F.split_part(at, F.lit(":"), F.lit(1)).cast("long").alias("doc_id"), F.split_part(at, F.lit(":"), F.lit(2)).cast("int").alias("seg_idx"), F.split_part("m", F.lit("|"), F.lit(2)).alias("quote"), at.alias("ref"))
    met = seg.join(segments, ["doc_id", "seg_idx"], "left")
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    stat = sections.select("section_id", F.explode(F.regexp_extract_all("body", F.lit(r"\{\{STAT:([^}]*)\}\}"), F.lit(1))).alias("m"))
    stat = stat.select("section_id", F.split_part("m", F.lit("="), F.lit(1)).alias("key"), F.split_part("m", F.lit("="), F.lit(2)).alias("said")).join(statistics, "key", "left")
    out = lambda df, kind, what: df.select(F.lit(kind).alias("type"), "section_id", F.col(what).cast("string").alias("subject"))
    wrong = F.regexp_replace("said", ",", "") != F.regexp_replace("value", ",", "")
    fault = F.when(F.col("text").isNull(), "invented_segment_id").when(~F.contains(flat("text"), flat("quote")), "wrong_segment_quote")
    return (
        met.select(fault.alias("type"), "section_id", F.col("ref").alias("subject")).filter("type IS NOT NULL")
        .unionByName(out(stat.filter("value IS NULL"), "unknown_project_statistic", "key")).unionByName(out(stat.filter(F.col("value").isNotNull() & wrong), "wrong_project_statistic", "key"))
    )
