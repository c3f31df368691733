"""Rules of a report's validator over whole reports: quotes of cases, made-up cases, and literature as it is registered and hashed.

Reports are (doc_id, body), one row each. Rules give (type, severity, doc_id, seg_idx, ref) as those of ``reports``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.operators.reports import _all, _rule

# References, quoting lines, and what may or must be said of made-up cases.
SEGMENT_REF = r"\[(seg-[A-Za-z0-9_-]+-\d{4,})\]"
QUOTE = r"(?md)^\s*>\s*\[(?:SOURCE|INITIAL|TARGET)\s+seg-[A-Za-z0-9_-]+-\d{4,}\]:\s*.*$"
SYNTHETIC_QUOTE = r"(?md)^\s*>\s*\[(?:SYNTHETIC_SOURCE|SIMULATED|OPTIMIZED)\s+SC-\d{4,}\]:\s*.*$"
SYNTHETIC_ID = r"\b(SC-\d{4,})\b"
AS_HISTORY = "(?i)笔者(?:的)?初译|作者(?:的)?初译|译者(?:的)?初译|经(?:审校|修订)后|初译阶段(?:出现|存在)|(?:后来|最终)(?:将|把).{0,40}(?:改为|修改为|修订为)|the (?:author|translator) originally translated|after (?:review|revision)"
FREQUENCY = "(?i)(?:常见|普遍|频繁)(?:的)?(?:人类|人工|译者)?(?:翻译)?错误|(?:common|frequent|widespread) human translation error"
METHOD, METHOD_SAID = "<!--synthetic-methodology-->", "(?s)模拟初译.{0,80}(?:不代表|并非).{0,20}(?:历史|实际|真实)"
LIMIT, LIMIT_SAID = "<!--synthetic-limitation-->", "(?:不|不能|无法).{0,30}(?:发生频率|发生率|错误频率)"
REAL_HEAD, MADE_HEAD = r"(?md)^#{3,6}\s+.*真实修订案例", r"(?md)^#{3,6}\s+.*合成对比案例"
MADE_SECTION = r"(?smd)^#{3,6}\s+.*合成对比案例.*?(?=^#{3,6}\s+|^##\s+|\z)"
_HEAD = r"(?s)^\s*>\s*\[([A-Z_]+)\s+([A-Za-z0-9_-]+)\]:\s*(.*)$"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def _all_of(pattern: str) -> Column:
    return F.regexp_extract_all("body", F.lit(f"({pattern})"), F.lit(1))


def _quotes(reports: DataFrame, pattern: str) -> DataFrame:
    line = reports.select("doc_id", F.explode(_all_of(pattern)).alias("line"))
    return line.select("doc_id", F.regexp_extract("line", _HEAD, 1).alias("kind"), F.regexp_extract("line", _HEAD, 2).alias("ref"), F.regexp_extract("line", _HEAD, 3).alias("quote"))


def quotation_violations(reports: DataFrame, segments: DataFrame, planned: DataFrame) -> DataFrame:
    """segments(doc_id, segment_id, source, initial_target, target), planned(doc_id, segment_id): references to no segment or to one that no section plans, and lines that quote a segment otherwise than it is stored."""
    used = reports.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(SEGMENT_REF), F.lit(1)))).alias("ref"))
    known = segments.withColumnRenamed("segment_id", "ref")
    met = _quotes(reports, QUOTE).join(known, ["doc_id", "ref"])
    stored = F.when(F.col("kind") == "SOURCE", F.col("source")).when(F.col("kind") == "INITIAL", F.col("initial_target")).otherwise(F.col("target"))
    kind = F.when(F.col("kind") == "INITIAL", "wrong_initial_translation").when(F.col("kind") == "TARGET", "wrong_final_translation").otherwise("wrong_segment_quote")
    return _all(
        _rule(used.join(known.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti"), "invented_segment_id"), _rule(used.join(planned.select("doc_id", F.col("segment_id").alias("ref")), ["doc_id", "ref"], "left_anti"), "unplanned_segment_reference"),
        _rule(met.filter(squeezed(F.col("quote")) != squeezed(stored)), kind),
    )


def made_up_case_violations(reports: DataFrame, selected: DataFrame, canonical: DataFrame) -> DataFrame:
    """What a report shows and says of made-up cases, where it has any.

    selected(doc_id, case_id, synthetic, source_text, baseline, optimized), a report's cases of both sorts; canonical(case_id, source_text, baseline, optimized, empirical), the made-up ones as they are stored. A quoted
    case is held against its stored form, or against the selected one if there is none."""
    c = F.col
    texts = ["source_text", "baseline", "optimized"]
    made = selected.filter("synthetic")
    quotes = _quotes(reports, SYNTHETIC_QUOTE)
    stored = canonical.select(c("case_id").alias("ref"), F.struct(*texts).alias("a"), F.lit(True).alias("stored"))
    chosen = made.select("doc_id", c("case_id").alias("ref"), F.struct(*texts).alias("b"), F.lit(True).alias("chosen"))
    met = quotes.join(stored, "ref", "left").join(chosen, ["doc_id", "ref"], "left").withColumn("x", F.coalesce("a", "b"))
    expected = F.when(c("kind") == "SYNTHETIC_SOURCE", c("x.source_text")).when(c("kind") == "SIMULATED", c("x.baseline")).otherwise(c("x.optimized"))
    known = c("stored").isNotNull() | c("chosen").isNotNull()
    shown = quotes.groupBy("doc_id", "ref").agg(F.collect_set("kind").alias("kinds"))
    bare = made.select("doc_id", c("case_id").alias("ref")).join(shown, ["doc_id", "ref"], "left").filter(F.coalesce(F.size("kinds"), F.lit(0)) < 3)
    sorts = selected.groupBy("doc_id").agg(F.collect_set(F.when(c("synthetic"), c("case_id"))).alias("ids"), F.bool_or(~c("synthetic")).alias("mixed")).filter(F.size("ids") > 0)
    own = reports.join(sorts, "doc_id")
    says = lambda mark, pattern: F.contains("body", F.lit(mark)) & c("body").rlike(pattern)
    paragraphs = own.filter(c("body").rlike(AS_HISTORY)).select("doc_id", "ids", _all_of(MADE_SECTION).alias("made"), F.explode(F.split("body", r"\n\s*\n")).alias("paragraph"))
    named = F.array_sort(F.array_intersect("ids", F.regexp_extract_all("paragraph", F.lit(SYNTHETIC_ID), F.lit(1))))
    within = (c("paragraph") != "") & F.exists("made", lambda x: F.contains(x, c("paragraph")))
    told = paragraphs.withColumn("named", named).filter(((F.size("named") > 0) | within) & c("paragraph").rlike(AS_HISTORY)).withColumn("ref", F.get("named", F.lit(0)))
    grounded = made.join(canonical.select("case_id", "empirical"), "case_id", "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("empirical", F.lit(False))).alias("grounded"))
    return _all(
        _rule(met.filter(~known), "unknown_synthetic_case"), _rule(met.filter(known & (squeezed(c("quote")) != squeezed(expected))), "wrong_synthetic_case_quote"), _rule(bare, "missing_synthetic_case_quotes"),
        _rule(own.filter(~says(METHOD, METHOD_SAID)), "missing_synthetic_methodology_disclosure"), _rule(own.filter(~says(LIMIT, LIMIT_SAID)), "missing_synthetic_limitation_disclosure"),
        _rule(own.filter(c("mixed") & ~(c("body").rlike(REAL_HEAD) & c("body").rlike(MADE_HEAD))), "mixed_case_groups_not_visible"), _rule(told, "synthetic_case_presented_as_historical"),
        _rule(own.join(grounded, "doc_id").filter(~c("grounded") & c("body").rlike(FREQUENCY)), "unsupported_human_error_frequency_claim"),
    )


def selection_violations(selections: DataFrame) -> DataFrame:
    """selections(doc_id, pipeline, policy, n_synthetic): made-up cases that couldn't be made (a warning), and reports that want only such and have none."""
    return _all(_rule(selections.filter("pipeline = 'failed'"), "synthetic_pipeline_unavailable", "warning"), _rule(selections.filter("policy = 'synthetic_only' AND n_synthetic = 0"), "synthetic_only_without_eligible_cases"))


def _stable(*fields: Column) -> Column:
    """SHA-256 of an object's JSON; fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def literature_record_violations(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """sources(source_id, title, year, authors, cited_title, cited_year, cited_authors, file_hash, content_hash), blocks(source_id, n, block_id, location, text, provenance, origin_id, content_hash): citations that differ from the registry, blocks whose
    id or hash isn't that of what they hold, and sources whose hash isn't that of their file and blocks. What a citation leaves out isn't compared."""
    c = F.col
    said = lambda x: F.coalesce(x, F.lit("")) != ""
    names = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), squeezed)
    differs = {
        "title": said(c("cited_title")) & (squeezed(c("cited_title")) != squeezed(c("title"))), "year": c("cited_year").isNotNull() & ~c("cited_year").cast("string").eqNullSafe(c("year").cast("string")), "authors": (F.size(names(c("cited_authors"))) > 0) & (names(c("cited_authors")) != names(c("authors"))),
    }
    cited = [_rule(sources.filter(x).withColumn("ref", c("source_id")), "literature_metadata_mismatch") for x in differs.values()]
    expected = _stable("location", "origin_id", "provenance", "source_id", "text")
    own = blocks.withColumn("expected", expected)
    broken = own.filter(~c("content_hash").eqNullSafe(c("expected")) | ~c("block_id").eqNullSafe(F.concat(F.lit("LB-"), F.substring("expected", 1, 16)))).withColumn("ref", c("block_id"))
    listed = blocks.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "block_id", "content_hash"))), lambda x: F.struct(x["block_id"].alias("block_id"), x["content_hash"].alias("content_hash"))).alias("blocks"))
    none = F.array().cast("array<struct<block_id:string,content_hash:string>>")
    whole = sources.join(listed, "source_id", "left").withColumn("blocks", F.coalesce("blocks", none)).filter((F.size("blocks") > 0) | said(c("file_hash")))
    wrong = whole.filter(~c("content_hash").eqNullSafe(_stable(c("file_hash").alias("binary_hash"), c("blocks")))).withColumn("ref", c("source_id"))
    return _all(*cited, _rule(broken, "literature_source_block_hash_mismatch"), _rule(wrong, "literature_source_content_hash_mismatch"))
