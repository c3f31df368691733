"""Requests for evidence and what they are answered with; plans made whole; hashes along the chain of literature; lines of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.python import find_span
from glossweave.operators.matching import term_matches_in

#: What may be asked for.
TOOLS = ("segment", "neighbors", "term")


def requests(asked: DataFrame, *, most: int = 5) -> DataFrame:
    """asked(doc_id, tool, arg, pos): of each document's requests those with a known tool, each once, the first ``most``, numbered."""
    once = asked.filter(F.col("tool").isin(*TOOLS)).groupBy("doc_id", "tool", "arg").agg(F.min("pos").alias("pos"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).filter(F.col("n") <= most)


def answer(asked: DataFrame, segments: DataFrame, occurrences: DataFrame, *, near: int = 2, octets: int = 24_000, blind: bool = False) -> DataFrame:
    """``requests`` with their answer: a segment's text, the texts around it, or the segments that hold a term (doc_id, term, seg_idx). Blind
    answers hide texts. Of an answer that is too large only the whole parts that fit are given, and ``cut`` says so; null if there is none."""
    number = F.expr("try_cast(arg AS INT)")
    shown = F.lit("[hidden]") if blind else F.col("text")
    own = asked.filter("tool <> 'term'").withColumn("at", number)
    spread = own.withColumn("seg_idx", F.explode(F.when(F.col("tool") == "segment", F.array("at")).otherwise(F.sequence(F.col("at") - near, F.col("at") + near))))
    texts = spread.join(segments, ["doc_id", "seg_idx"]).select("doc_id", "n", "seg_idx", shown.alias("part"))
    terms = asked.filter("tool = 'term'").join(occurrences.withColumnRenamed("term", "arg"), ["doc_id", "arg"]).select("doc_id", "n", "seg_idx", F.col("seg_idx").cast("string").alias("part"))
    parts = texts.unionByName(terms)
    until = F.sum(F.octet_length("part") + 1).over(Window.partitionBy("doc_id", "n").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0))
    fit = parts.withColumn("fits", until <= octets + 1)
    got = fit.groupBy("doc_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("seg_idx", "part")))), lambda x: x["part"]), "\n").alias("answer"), F.bool_or(~F.col("fits")).alias("cut"))
    return asked.join(got, ["doc_id", "n"], "left").select("doc_id", "n", "tool", "arg", "answer", F.coalesce("cut", F.lit(False)).alias("cut"))


def case_plans(selected: DataFrame, plans: DataFrame, cannot: DataFrame) -> DataFrame:
    """A plan for every selected case (case_id): the first of ``plans`` (case_id, problem, failure, rationale, pos) for it, or an empty one; what a case
    ``cannot`` support (case_id, what) isn't planned."""
    first = plans.groupBy("case_id").agg(*[F.min_by(c, "pos").alias(c) for c in ("problem", "failure", "rationale")])
    barred = cannot.groupBy("case_id").agg(F.collect_set("what").alias("cannot"))
    own = selected.select("case_id").distinct().join(first.withColumn("made", F.lit(True)), "case_id", "left").join(barred, "case_id", "left")
    may = lambda what: ~F.array_contains(F.coalesce("cannot", F.array().cast("array<string>")), what)
    return own.select(
        "case_id", F.coalesce("made", F.lit(False)).alias("planned"), F.coalesce("problem", F.lit("")).alias("problem"), F.when(may("initial_failure_reasoning"), F.col("failure")).alias("failure"), F.when(may("process_claims"), F.col("rationale")).alias("rationale"),
    )


def _hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def hash_violations(sources: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """(type, subject) where a stored hash isn't that of what is stored, along sources (source_id, text, content_hash), evidence (evidence_id,
    source_id, text, source_hash, content_hash) and claims (claim_id, statement, evidence_id, content_hash)."""
    row = lambda df, kind, c: df.select(F.lit(kind).alias("type"), F.col(c).alias("subject"))
    held = evidence.join(sources.select("source_id", F.col("content_hash").alias("of_source")), "source_id", "left")
    rules = [
        row(sources.filter(_hash("text") != F.col("content_hash")), "literature_source_content_hash_mismatch", "source_id"), row(held.filter(F.col("of_source").isNotNull() & (F.col("source_hash") != F.col("of_source"))), "literature_source_hash_mismatch", "evidence_id"),
        row(evidence.filter(_hash("source_id", "text") != F.col("content_hash")), "literature_evidence_hash_mismatch", "evidence_id"), row(claims.filter(_hash("statement", "evidence_id") != F.col("content_hash")), "literature_claim_hash_mismatch", "claim_id"),
    ]
    out = rules[0]
    for more in rules[1:]:
        out = out.unionByName(more)
    return out


def term_notes(segments: DataFrame, glossary: DataFrame, *, least: int = 2) -> DataFrame:
    """Terms that stand in a segment as they are written, inside words too, as annotations of a domain; terms shorter than ``least`` don't count."""
    held = term_matches_in(segments, glossary.filter(F.length("source") >= least).select("id", "source"), how="exact", keep=["doc_id", "seg_idx"])
    return held.select("doc_id", "seg_idx", F.lit("domain").alias("type"), "id", F.concat(F.lit("术语："), "source").alias("note"))


def term_spans(pairs: DataFrame, glossary: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """(keys, id, src_start, src_end, tgt_start, tgt_end, note): where each term first stands in a pair's source, as it is written and inside words too, and its preferred form in the target, whatever the shape of quotes and white space; null if it
    isn't there or there is none. A term without a preferred form is to be kept as it is, and the note says so."""
    term = F.trim("source_term")
    terms = glossary.select("id", F.trim("source").alias("source_term"), F.trim(F.coalesce("preferred", F.lit(""))).alias("wanted")).filter(F.length(term) >= least)
    met = term_matches_in(pairs, terms, text_col="source", term_col="source_term", how="exact", keep=[*keys, "target"], positions="at")
    start = F.array_min("at")
    found = met.withColumn("span", find_span(F.when(F.col("wanted") != "", F.col("wanted")).otherwise(""), F.coalesce("target", F.lit(""))))
    note = F.concat(F.lit("术语："), "source_term", F.lit(" -> "), F.when(F.col("wanted") == "", "保留原文").otherwise(F.col("wanted")))
    return found.select(*keys, "id", start.alias("src_start"), (start + F.length("source_term")).alias("src_end"), F.col("span.start").alias("tgt_start"), F.col("span.end").alias("tgt_end"), note.alias("note"))


#: Of one pair at most, by type. Fixed values.
MOST = {"rare": 3, "domain": 3, "hard": 2}
_ITEM = "struct<type:string,src_span:array<int>,tgt_span:array<int>,note:string>"


def annotations(states: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stored annotations, (job, notes) with notes a JSON object from places to lists, as rows (job, seg_idx, n, type, src_span, tgt_span, note): keys that are no number, values that are no list, and places beyond the job's
    pairs (job, size) go. Of items with one type and spans the first stays, and of each type the first few of a pair."""
    each = states.select("job", F.explode(F.from_json("notes", "map<string,string>")).alias("key", "value")).withColumn("seg_idx", F.expr("try_cast(trim(key) AS INT)"))
    there = each.filter(F.col("seg_idx").isNotNull() & F.ltrim("value").startswith("[")).join(sizes, "job").filter("seg_idx >= 0 AND seg_idx < size")
    items = there.select("job", "seg_idx", F.posexplode(F.from_json("value", f"array<{_ITEM}>")).alias("pos", "x")).filter(F.col("x.type").isin(*MOST)).select("job", "seg_idx", "pos", "x.*")
    same = Window.partitionBy("job", "seg_idx", "type", F.to_json(F.struct("src_span")), F.to_json(F.struct("tgt_span"))).orderBy("pos")
    first = items.withColumn("again", F.row_number().over(same)).filter("again = 1")
    n = F.row_number().over(Window.partitionBy("job", "seg_idx", "type").orderBy("pos"))
    most = F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv])[F.col("type")]
    return first.withColumn("n", n).filter(F.col("n") <= most).select("job", "seg_idx", "n", "type", "src_span", "tgt_span", "note")


def report_lines(findings: DataFrame) -> DataFrame:
    """Findings as lines of a report, the worst first; ``files.write_lines`` writes them."""
    mark = F.when(F.col("resolved"), "x").otherwise(" ")
    rank = F.array_position(F.array(F.lit("blocking"), F.lit("actionable"), F.lit("informational")), F.col("severity"))
    line = F.concat(F.lit("- ["), mark, F.lit("] "), "severity", F.lit(" "), "conv_id", F.lit(":"), "seg_idx", F.lit(" "), "type")
    return findings.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(rank, "event_id")).alias("n"), line.alias("line"))
