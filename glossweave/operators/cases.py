"""Cases for study: which revisions are real, what a segment has in evidence, how cases are scored, chosen, classed and replaced.

Records are (conv_id, seg_idx, source, target, initial_target, from_tm, reviewed), findings as in ``delivery``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.python import ALIKE, bare, meaningful_revision, tail_similarity
from glossweave.operators.chain import Deal, as_they_are
from glossweave.operators.matching import with_term_count

KEY = ["conv_id", "seg_idx"]
# Words that open clauses, the passive, marks and quotations that make a source complex, and what each adds to a score.
CLAUSES = "although|because|before|after|while|whereas|which|that|who|whom|whose|when|where|if|unless|since|as|despite|whether"
PASSIVE = r"(?iU)\b(?:is|are|was|were|be|been|being)\s+(?:\w+\s+){0,2}\w+(?:ed|en)\b"
MARKS = r"[,;:—–\-()\[\]\"“”‘’]"
QUOTING = r"[\"“”‘’]|—|–"
#: Signals that a source is hard, by name.
SIGNALS = {
    "negation_scope": "not|never|neither|nor|no longer|without", "logical_relation": "although|unless|whereas|despite|while|since", "syntax_attachment": "which|that|who|whom|whose",
    "reference_resolution": "it|this|that|they|them|he|she|his|her", "temporal_relation": "before|after|until|when|then|already|still",
}
ZONES = ("beginning", "middle", "end")


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row``, an aggregate of one row."""
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(row.withColumn("__one", F.lit(1))), "__one").drop("__one")


def integrity_flags(records: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """``records`` with ``revised`` and ``flags``: why a revision may be none, its first version standing in a neighbour's target or its last
    one running on into the next's."""
    w = Window.partitionBy("conv_id").orderBy("seg_idx")
    own = records.withColumn("revised", F.coalesce(meaningful_revision("initial_target", "target"), F.lit(False))).withColumn("__initial", bare("initial_target")).withColumn("__final", bare("target"))
    own = deal(own, "conv_id")  # after the Python functions, over which Spark forgets how rows are dealt
    near = F.coalesce(F.contains(F.lag("__final").over(w), "__initial"), F.lit(False)) | F.coalesce(F.contains(F.lead("__final").over(w), "__initial"), F.lit(False))
    own = own.withColumn("__near", near).withColumn("__next", F.lead("target").over(w))
    first = F.when(F.col("revised") & (F.length("__initial") >= 8) & F.col("__near"), "probable_adjacent_initial_target_overlap")
    second = F.when(F.col("revised") & (tail_similarity(F.when(F.col("revised"), F.col("target")), F.when(F.col("revised"), F.col("__next"))) >= ALIKE), "probable_adjacent_target_overlap")
    return own.withColumn("flags", F.array_compact(F.array(second, first))).drop("__initial", "__final", "__near", "__next")


def process(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Per pair what its findings and their settling amount to, beside the pair."""
    n = lambda c, name: F.sum(c.cast("int")).alias(name)
    c = F.col
    by = findings.groupBy(*KEY).agg(
        F.count("*").alias("n_findings"), n(c("severity") == "blocking", "blocking"), n(c("severity") == "actionable", "actionable"), n(c("severity") == "informational", "informational"),
        F.bool_or("conflict").alias("conflict"), F.bool_or(F.coalesce(c("action") == "retranslated", F.lit(False))).alias("repair"), F.bool_or(F.coalesce(c("action") == "human_fixed", F.lit(False))).alias("human"),
    )
    zero = {**dict.fromkeys(("n_findings", "blocking", "actionable", "informational"), 0), **dict.fromkeys(("conflict", "repair", "human"), False)}
    return records.join(by, KEY, "left").fillna(zero)


def features(rows: DataFrame, glossary: DataFrame | None) -> DataFrame:
    """``rows`` of ``process`` over ``integrity_flags``, with ``score`` and ``reasons``; without a glossary no term counts."""
    c, least = F.col, F.least
    own = rows.withColumn("terms", F.lit(0)) if glossary is None else with_term_count(rows, glossary, name="terms", text_col="source", how="lower")
    own = own.withColumn("chars", F.length("source")).withColumn("clauses", F.regexp_count("source", F.lit(rf"(?iU)\b(?:{CLAUSES})\b"))).withColumn("marks", F.regexp_count("source", F.lit(MARKS)))
    own = own.withColumn("repaired", c("revised") & (c("repair") | c("human"))).withColumn("chain", (c("source") != "") & (c("n_findings") > 0) & c("repaired"))
    parts = [
        (c("chain"), F.lit(40.0), "complete_translation_evidence_chain"), (c("blocking") > 0, 24 + least(c("blocking"), F.lit(2)), "blocking_finding"), (c("actionable") > 0, 20 + least(c("actionable"), F.lit(3)), "actionable_finding"),
        (c("repaired"), F.lit(18), "revision_with_repair_link"), (c("revised"), F.lit(12), "meaningful_initial_final_revision"), (c("conflict"), F.lit(5), "terminology_conflict"), (c("terms") > 0, least(F.lit(4.0), c("terms") * 1.5), "terminology_dense"),
        (c("from_tm"), F.lit(1), "tm_reuse"), (c("chars") >= 180, least(F.lit(5.0), c("chars") / 100), "long_source"), (c("clauses") >= 2, least(F.lit(4), c("clauses")), "clause_complexity"), (c("marks") >= 5, least(F.lit(3.0), c("marks") / 3), "punctuation_complexity"),
        (c("source").rlike(PASSIVE), F.lit(1.5), "passive_construction"), (c("source").rlike(QUOTING), F.lit(1.0), "quotation_or_dash_complexity"), (F.size("flags") > 0, F.lit(-100.0), "integrity_review_required"),
    ]
    score = F.when((c("informational") > 0) & (c("blocking") + c("actionable") == 0), least(F.lit(1.0), c("informational") * 0.2)).otherwise(0.0)
    for on, value, _ in parts:
        score += F.when(on, value).otherwise(0)
    return own.withColumn("score", F.round(score, 3)).withColumn("reasons", F.array_compact(F.array(*[F.when(on, name) for on, _, name in parts])))


def zone(position: str, *keys: str) -> Column:
    """Terciles by position over the last position."""
    at = F.col(position) / F.greatest(F.max(position).over(Window.partitionBy(*keys)), F.lit(1))
    return F.when(at < 1 / 3, ZONES[0]).when(at < 2 / 3, ZONES[1]).otherwise(ZONES[2])


def distributions(records: DataFrame, findings: DataFrame) -> DataFrame:
    """(conv_id, distribution, category, n) of each job: open findings by type, repairs by what was done and by revisions, and segments by zone."""
    n = F.count("*").alias("n")
    part = lambda df, name, category: df.groupBy("conv_id", F.lit(name).alias("distribution"), category.alias("category")).agg(n)
    open_, acted = part(findings.filter("NOT resolved"), "issue", F.col("type")), part(findings, "repair", F.coalesce("action", F.lit("none")))
    changed = part(records.filter("revised"), "repair", F.lit("initial_final_changed"))
    placed = part(records.withColumn("zone", zone("seg_idx", "conv_id")), "coverage", F.col("zone"))
    return open_.unionByName(acted).unionByName(changed).unionByName(placed)


def mine(scored: DataFrame, *, most: int = 80) -> DataFrame:
    """Per job, of its real revisions: the best three of each zone, then the best of the rest with a score above 0, ``most`` in all."""
    per_zone = min(3, max(1, most // 3))
    own = scored.withColumn("zone", zone("seg_idx", "conv_id")).filter("revised")
    best = F.row_number().over(Window.partitionBy("conv_id", "zone").orderBy(F.desc("score"), "seg_idx"))
    placed = own.withColumn("late", (best > per_zone).cast("int")).filter("late = 0 OR score > 0")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("late", F.desc("score"), "seg_idx"))
    status = F.when(F.size("flags") > 0, "review_required").otherwise("eligible")
    return placed.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("status", status).drop("late", "rank")


def signals(rows: DataFrame) -> DataFrame:
    """``rows`` of ``process`` with the richness of their evidence (0 to 7) and whether they are real revisions."""
    c = F.col
    changed = c("revised") & (F.size("flags") == 0)
    has = c("n_findings") > 0
    rich = sum((x.cast("int") for x in (changed, c("repair"), c("used_terms") > 0, c("initial_target").isNotNull(), has, c("repair"))), has.cast("int"))
    return rows.withColumn("changed", changed).withColumn("richness", rich).withColumn("severe", c("blocking") + c("actionable") > 0)


def case_class(selected: Column) -> Column:
    """The class of a case that ``signals`` describes."""
    c = F.col
    return F.when(~selected, "misaligned_case").when(~c("changed"), "weak_case").when((c("richness") >= 5) & c("severe"), "strong_case").otherwise("usable_case")


def adequacy(rows: DataFrame) -> DataFrame:
    """What the evidence of each case can and cannot support."""
    c = F.col
    words = lambda *x: F.array(*map(F.lit, x))
    terms = c("used_terms") > 0
    whole, process_ = c("repair") & c("severe"), c("repair") & (c("severe") | terms)
    level = F.when(~c("changed"), "source_final_only").when(process_, "rich_process_evidence").otherwise("partial_process_evidence")
    can = F.when(~c("changed"), words("textual_analysis")).when(whole, words("textual_analysis", "translation_decision", "revision_reasoning", "error_repair_analysis")).when(process_, words("textual_analysis", "translation_decision", "revision_reasoning"))
    can = can.otherwise(words("textual_analysis", "translation_decision", "limited_process_inference"))
    cannot = F.when(~c("changed"), words("historical_revision_reasoning", "initial_failure_reasoning", "process_claims", "revision_case_analysis")).when(whole, F.array().cast("array<string>")).when(process_, words("error_repair_analysis"))
    return rows.withColumn("level", level).withColumn("can", can).withColumn("cannot", cannot.otherwise(words("historical_revision_reasoning")))


def replacements(cases: DataFrame, *, least: int = 3) -> DataFrame:
    """For each selected case of a job the best one that isn't selected, is eligible, and is richer than it and rich enough.

    Only the best of each richness can be chosen, so a job's candidates shrink to eight rows before they meet its cases."""
    order = Window.partitionBy("conv_id", "richness").orderBy(F.desc("relevance"), F.desc("score"), "seg_idx")
    pool = cases.filter(~F.col("selected") & F.col("eligible") & (F.col("richness") >= least)).withColumn("n", F.row_number().over(order)).filter("n = 1")
    pool = pool.groupBy("conv_id").agg(F.max(F.struct("richness", F.col("seg_idx").alias("by"))).alias("best"))
    chosen = cases.filter("selected").join(pool, "conv_id").filter("best.richness > richness")
    return chosen.select("conv_id", "seg_idx", F.col("best.by").alias("replacement"))


def screening(text: Column) -> Column:
    """Names of the signals in a source."""
    found = [F.when(text.rlike(rf"(?iU)\b(?:{words})\b"), name) for name, words in SIGNALS.items()]
    comma = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    # Marks of structure, proper nouns, and verbs with a particle.
    found += [
        F.when(text.rlike("[—–:;]|[“”\"]"), "information_structure"), F.when(text.rlike(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), "proper_noun"), F.when((F.length(text) >= 100) & (comma >= 2), "multi_clause_structure"),
        F.when(text.rlike(r"(?iU)\b[A-Za-z]+(?:ed|ing)\s+(?:at|for|from|into|of|off|on|out|over|to|up|with)\b"), "lexical_or_idiomatic_phrase"),
    ]
    return F.array_compact(F.array(*found))


def source_pool(segments: DataFrame, *, most: int) -> DataFrame:
    """Per document the segments with most signals, one of each zone at least, with the clipped texts around them."""
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    own = segments.select("doc_id", "seg_idx", F.substring("text", 1, 1200).alias("source"), F.length("text").alias("n"), screening(F.col("text")).alias("signals"), zone("seg_idx", "doc_id").alias("zone"))
    own = own.withColumn("before", F.substring(F.lag("source").over(w), 1, 500)).withColumn("after", F.substring(F.lead("source").over(w), 1, 500)).filter(F.size("signals") > 0)
    order = (F.desc(F.size("signals")), F.desc(F.least("n", F.lit(300))), "seg_idx")
    first = F.row_number().over(Window.partitionBy("doc_id", "zone").orderBy(*order)) > 1
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("late"), *order))
    return own.withColumn("late", first).withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "seg_idx", "source", "before", "after", "signals")
