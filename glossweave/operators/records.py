"""Records made sound, checked and exported: evidence, sections, findings, entries, manifests, exchange files, and text that refers to records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.text import CJK, PRESERVED, strip

# What records may say.
EVIDENCE_TYPES = ("user", "local_termbase", "project_override", "model_knowledge", "external")
BEHAVIORS, STATUSES = ("translate", "preserve"), ("candidate", "provisional", "locked", "rejected")
SEVERITIES = ("blocking", "actionable", "informational")
FORGED, DEMOTED = "[已清除疑似伪造 URL]", "[无真实外部来源，已降级为模型知识]"
LINE_KEYS = ("segment_id", "source", "target", "reviewed", "from_tm", "glossary_entry_ids", "findings", "delivery_status")
DELIVERY = ("draft", "review_required", "approved", "final")


def _clean(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit("")))


def evidence(rows: DataFrame) -> DataFrame:
    """Evidence of terms (evidence_type, url, note, source_name): unknown types are a model's knowledge, which has no address; external evidence
    without one is that too."""
    c = F.col
    kind, url, note = F.lower(_clean(c("evidence_type"))), _clean(c("url")), _clean(c("note"))
    own = rows.withColumn("__kind", F.when(kind.isin(*EVIDENCE_TYPES), kind).otherwise("model_knowledge")).withColumn("url", url).withColumn("note", note).withColumn("source_name", _clean(c("source_name")))
    forged, bare = (c("__kind") == "model_knowledge") & (c("url") != ""), (c("__kind") == "external") & (c("url") == "")
    remark = lambda x: F.when(c("note") == "", x).otherwise(F.concat_ws("；", "note", F.lit(x)))
    own = own.withColumn("note", F.when(forged, remark(FORGED)).when(bare, remark(DEMOTED)).otherwise(c("note")))
    return own.withColumn("source_name", F.when(bare, "").otherwise(c("source_name"))).withColumn("evidence_type", F.when(bare, "model_knowledge").otherwise(c("__kind"))).withColumn("url", F.when(forged, "").otherwise(c("url"))).drop("__kind")


def section_profiles(rows: DataFrame) -> DataFrame:
    """Sections (start_segment and end_segment as text, section_id, pos) that are ranges, with a name if they have none."""
    start, end = (F.try_to_number(F.col(x), F.lit("S999999999")).cast("int") for x in ("start_segment", "end_segment"))
    own = rows.withColumn("start_segment", start).withColumn("end_segment", end).filter("start_segment >= 0 AND end_segment >= start_segment")
    return own.withColumn("section_id", F.when(_clean(F.col("section_id")) == "", F.concat(F.lit("section-"), F.col("pos") + 1)).otherwise(_clean(F.col("section_id"))))


PROFILE = ("domain", "subdomain", "genre", "audience", "register", "style_constraints")
_RANGE = "array<struct<section_id:string,start_segment:int,end_segment:int,topic:string,domain:string>>"


def document_profiles(rows: DataFrame) -> DataFrame:
    """Profiles of documents (the fields of ``PROFILE``, confidence as text, sections as structs of section_id, start_segment and end_segment as text, topic and domain) made sound: blanks for what is missing, a confidence of 0 for what is no
    number, and of the sections those that are ranges, with a name by their place if they have none."""
    number = lambda x: F.try_to_number(x, F.lit("S999999999")).cast("int")
    numbered = F.transform("sections", lambda x, i: F.struct(x["section_id"].alias("section_id"), number(x["start_segment"]).alias("a"), number(x["end_segment"]).alias("z"), x["topic"].alias("topic"), x["domain"].alias("domain"), i.alias("i")))
    ranges = F.filter(numbered, lambda x: F.coalesce((x["a"] >= 0) & (x["z"] >= x["a"]), F.lit(False)))
    named = lambda x: F.when(_clean(x["section_id"]) == "", F.concat(F.lit("section-"), x["i"] + 1)).otherwise(_clean(x["section_id"]))
    kept = F.transform(ranges, lambda x: F.struct(named(x).alias("section_id"), x["a"].alias("start_segment"), x["z"].alias("end_segment"), _clean(x["topic"]).alias("topic"), _clean(x["domain"]).alias("domain")))
    own = rows.withColumns({c: _clean(F.col(c)) for c in PROFILE})
    return own.withColumn("confidence", F.coalesce(F.expr("try_cast(trim(confidence) AS DOUBLE)"), F.lit(0.0))).withColumn("sections", F.coalesce(kept, F.array().cast(_RANGE)))


def _errors(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(on, name) for name, on in rules.items()]))).alias("error"))


def profile_errors(profiles: DataFrame, key: str, *, least: float = 0.2) -> DataFrame:
    """(key, error) of ``document_profiles``: no domain, little confidence, and a row for each section that says neither topic nor domain."""
    bare = profiles.select(key, F.explode("sections").alias("x")).filter("x.topic = '' AND x.domain = ''").select(key, F.concat(F.lit("bare_section:"), "x.section_id").alias("error"))
    return _errors(profiles, key, {"missing_domain": F.col("domain") == "", "low_confidence": F.col("confidence") < least}).unionByName(bare)


def evidence_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, error) of evidence of terms: unknown types, a model's knowledge with an address, external evidence without one, and local evidence that names no source."""
    c = F.col
    said = lambda x: F.coalesce(c(x), F.lit("")) != ""
    kind = F.coalesce(c("evidence_type"), F.lit(""))
    return _errors(rows, key, {"unknown_type": ~kind.isin(*EVIDENCE_TYPES), "model_with_url": (kind == "model_knowledge") & said("url"), "external_without_url": (kind == "external") & ~said("url"), "missing_source_name": kind.isin("user", "local_termbase", "project_override") & ~said("source_name")})


def frozen_errors(frozen: DataFrame, entries: DataFrame) -> DataFrame:
    """(version, error) of frozen glossaries (version, glossary_hash, frozen_at) against their entries (version, entry_id, source, preferred, behavior, status): none, a hash that isn't theirs, no time, and what is wrong with an entry."""
    own = entries.groupBy("version").agg(entries_hash().alias("expected"), F.count("*").alias("n"))
    met = frozen.join(own, "version", "left")
    rules = {"empty": F.col("n").isNull(), "hash_mismatch": ~F.col("glossary_hash").eqNullSafe(F.coalesce("expected", F.sha2(F.lit(""), 256))), "missing_time": F.coalesce("frozen_at", F.lit("")) == ""}
    broken = entry_errors(entries, "version", "entry_id").select("version", F.concat_ws(":", "error", "entry_id").alias("error"))
    return _errors(met, "version", rules).unionByName(broken.join(frozen.select("version"), "version", "left_semi"))


def entries_hash() -> Column:
    """One hash of a group's entries in any order."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("source", "preferred", "behavior", "status"))), 256)
    return F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256)


def entry_errors(entries: DataFrame, *keys: str) -> DataFrame:
    """(keys, error) for each rule that a glossary entry breaks; keyed by entry_id if nothing else is said."""
    c = F.col
    none = lambda x: F.coalesce(c(x), F.lit("")) == ""
    rules = {
        "missing_source": none("source"), "unknown_behavior": ~F.coalesce(c("behavior"), F.lit("")).isin(*BEHAVIORS), "unknown_status": ~F.coalesce(c("status"), F.lit("")).isin(*STATUSES),
        "translate_without_preferred": (c("behavior") == "translate") & none("preferred"), "locked_without_preferred": (c("status") == "locked") & none("preferred"),
    }
    return entries.select(*(keys or ("entry_id",)), F.explode(F.array_compact(F.array(*[F.when(on, name) for name, on in rules.items()]))).alias("error"))


def review_findings(rows: DataFrame, segments: DataFrame, evidence_ids: DataFrame) -> DataFrame:
    """A reviewer's findings (doc_id, batch, severity, segment_id, local, refs, reason), each with ``problem``, null for those that hold: a severity
    is known, and the segment, or else the one with that place in the batch, is the batch's; with the references that aren't known."""
    c = F.col
    placed = segments.select("doc_id", "batch", F.col("seg_idx").alias("by_place"), (F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("seg_idx")) - 1).alias("local"))
    own = rows.join(placed, ["doc_id", "batch", "local"], "left").withColumn("segment_id", F.coalesce("segment_id", "by_place")).drop("by_place")
    there = segments.select("doc_id", "batch", F.col("seg_idx").alias("segment_id"), F.lit(True).alias("there"))
    own = own.join(there, ["doc_id", "batch", "segment_id"], "left")
    problem = F.when(~F.coalesce(c("severity"), F.lit("")).isin(*SEVERITIES), "invalid_severity").when(c("segment_id").isNull(), "missing_segment_id").when(c("there").isNull(), "unknown_segment")
    strange = rows.select("doc_id", "pos", F.explode("refs").alias("ref")).filter(F.trim("ref") != "").join(evidence_ids, "ref", "left_anti").groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set("ref")).alias("unknown_refs"))
    return own.withColumn("problem", problem).join(strange, ["doc_id", "pos"], "left").withColumn("reason", F.coalesce(F.nullif(_clean(c("reason")), F.lit("")), F.lit("审校发现问题"))).drop("there")


def expand(texts: DataFrame, registry: DataFrame, *keys: str) -> DataFrame:
    """``texts`` (keys, body) with their tokens {{STAT:k}}, {{TERM:k}} and [@k] replaced by the registry's (token, value), which has one row a token; unknown ones stay."""
    return substituted(texts, registry.select("token", F.col("value").alias("instead")), *keys, pattern=r"\{\{(?:STAT|TERM):[A-Za-z0-9_.:-]+\}\}|\[@[A-Za-z0-9_.:-]+\]", of=lambda x: {"token": x})


def substituted(texts: DataFrame, registry: DataFrame, *keys: str, pattern: str, of: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``texts`` (keys, body) with each match of ``pattern`` replaced by the ``instead`` of the registry's row with the match's columns ``of``, if there is one.

    The matches meet the registry by their place in the body and are put back between the parts around them, so what is put in is never read again."""
    found = texts.select(*keys, F.posexplode(F.regexp_extract_all("body", F.lit(f"({pattern})"), F.lit(1))).alias("__n", "__match"))
    for name, x in of(F.col("__match")).items():
        found = found.withColumn(name, x)
    met = found.join(registry, [c for c in registry.columns if c != "instead"]).filter("instead IS NOT NULL")
    by = met.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__n", "instead"))).alias("__by"))
    matches, between = F.regexp_extract_all("body", F.lit(f"({pattern})"), F.lit(1)), F.split("body", pattern, -1)
    instead = F.transform(matches, lambda m, i: F.concat(F.coalesce(F.element_at("__by", i), m), F.get(between, i + 1)))
    body = F.when(F.col("__by").isNotNull(), F.concat(F.get(between, F.lit(0)), F.array_join(instead, ""))).otherwise(F.col("body"))
    return texts.join(by, list(keys), "left").withColumn("body", body).drop("__by")


#: Fixed value: a line that quotes a case.
QUOTE = r"(?md)^>\s*\[(?:SOURCE|INITIAL|TARGET|SYNTHETIC_SOURCE|SIMULATED|OPTIMIZED)\s+[A-Za-z0-9_-]+\]:\s*.*$"


def exact_quotes(reports: DataFrame, cases: DataFrame, *keys: str) -> DataFrame:
    """``reports`` (keys, body) whose quoting lines hold the saved text of their case word for word; cases(kind, case_id, text), where a text that is missing leaves the line as it is."""
    head = lambda x, k: F.regexp_extract(x, r"^>\s*\[([A-Z_]+)\s+([A-Za-z0-9_-]+)\]:", k)
    said = F.concat(F.lit("> ["), "kind", F.lit(" "), "case_id", F.lit("]: "), "text")
    return substituted(reports, cases.select("kind", "case_id", said.alias("instead")), *keys, pattern=QUOTE, of=lambda x: {"kind": head(x, 1), "case_id": head(x, 2)})


def batch_sections(batches: DataFrame, sections: DataFrame) -> DataFrame:
    """Per batch (doc_id, batch, first, last) the first section that holds it whole."""
    met = batches.alias("b").join(sections.alias("s"), F.expr("b.doc_id = s.doc_id AND s.start_segment <= b.first AND b.last <= s.end_segment"), "left")
    return met.groupBy("b.doc_id", "b.batch").agg(F.min_by("s.section_id", "s.start_segment").alias("section_id"))


def with_entries(pairs: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """``pairs`` (keys, entry_ids) with the terms of their entries, in the order of the ids; unknown ids go."""
    each = pairs.select(*keys, F.posexplode("entry_ids").alias("n", "id")).join(entries.select("id", "source"), "id")
    own = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda x: x["source"]).alias("terms"))
    return pairs.join(own, list(keys), "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def grid(rows: DataFrame, *, status: str | None = None, conflict: bool | None = None, contains: str = "", column: str = "source") -> DataFrame:
    """What a table of entries shows: of a status, in conflict or not, holding a text whatever its case."""
    tests = [F.col("status") == status] * (status is not None) + [F.col("conflict") == F.lit(conflict)] * (conflict is not None) + [F.contains(F.lower(column), F.lit(contains.lower()))] * (contains != "")
    return rows.filter(reduce(Column.__and__, tests, F.lit(True)))


def rate_limited(message: Column) -> Column:
    return message.rlike("429|RESOURCE_EXHAUSTED") | F.lower(message).contains("rate limit")


def holds(needle: Column, text: Column) -> Column:
    """Whether a text holds another, white space and case aside; an empty one never."""
    flat = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    return (flat(needle) != "") & F.contains(flat(text), flat(needle))


def manifest_violations(manifests: DataFrame, state: DataFrame) -> DataFrame:
    """(conv_id, problem) where a manifest's numbers aren't those of its job's state."""
    own = manifests.alias("m").join(state.alias("s"), "conv_id")
    numbers = ("segment_count", "tm_reused", "blocking", "actionable", "informational", "unresolved")
    tests = [F.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")), f"{c}_differs") for c in numbers] + [F.when(~F.col("m.delivery_status").isin(*DELIVERY), "unknown_delivery_status")]
    return own.select("conv_id", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def line_violations(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, problem) of exported lines: no JSON object, or keys that it lacks."""
    parsed = F.try_parse_json("line")
    lost = F.array_compact(F.array(*[F.when(F.try_variant_get(parsed, f"$.{k}", "variant").isNull(), f"missing_{k}") for k in LINE_KEYS]))
    whole = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return lines.select(*keys, F.explode(F.when(whole, lost).otherwise(F.array(F.lit("invalid_json")))).alias("problem"))


def xml_text(x: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), F.coalesce(x, F.lit("")))


def tmx_units(pairs: DataFrame, *, source_lang: str = "en", target_lang: str = "zh-CN") -> DataFrame:
    """``pairs`` (conv_id, seg_idx, source, target, from_tm) with their translation unit as an exchange file has it."""
    tuv = lambda lang, x: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), xml_text(F.col(x)), F.lit("</seg></tuv>"))
    prop = F.concat(F.lit('<prop type="from_tm">'), F.col("from_tm").cast("string"), F.lit("</prop>"))
    return pairs.withColumn("tu", F.concat(F.lit('<tu segid="'), "conv_id", F.lit("-"), "seg_idx", F.lit('">'), prop, tuv(source_lang, "source"), tuv(target_lang, "target"), F.lit("</tu>")))


def tbx_entries(entries: DataFrame, *, source_lang: str = "en", target_lang: str = "zh-CN") -> DataFrame:
    """``entries`` with their term entry: the source, what it is rendered by or that it stays, and what is prohibited."""
    c = F.col
    term = lambda x, note: F.concat(F.lit("<tig><term>"), xml_text(x), F.lit("</term>"), note, F.lit("</tig>"))
    note = lambda kind, x: F.concat(F.lit(f'<termNote type="{kind}">'), x, F.lit("</termNote>"))
    banned = F.array_join(F.transform("forbidden", lambda x: F.concat(F.lit("<ntig><termGrp><term>"), xml_text(x), F.lit('</term><termNote type="termStatus">prohibited</termNote></termGrp></ntig>'))), "")
    rendered = F.when(c("behavior") == "preserve", term(c("source"), note("behavior", F.lit("preserve")))).otherwise(F.concat(term(c("preferred"), note("termStatus", c("status"))), banned))
    lang = lambda code, x: F.concat(F.lit(f'<langSet xml:lang="{code}">'), x, F.lit("</langSet>"))
    return entries.withColumn("entry", F.concat(F.lit('<termEntry id="'), "id", F.lit('">'), lang(source_lang, term(c("source"), F.lit(""))), lang(target_lang, rendered), F.lit("</termEntry>")))


def xml_violations(rows: DataFrame, column: str, *keys: str, parts: dict[str, int], some: str) -> DataFrame:
    """(keys, problem) of exchange records: an element that isn't there as often as it must be, or not at all."""
    tests = [F.when(F.xpath_int(column, F.lit(f"count({path})")) != n, f"not_{n}_{path.split('/')[-1]}") for path, n in parts.items()] + [F.when(F.xpath_int(column, F.lit(f"count({some})")) == 0, f"no_{some.split('/')[-1]}")]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def statistic(stats: Column, path: Column) -> Column:
    """The value at a dotted path of a JSON object, as a report renders it; null if it isn't there."""
    return F.call_function("get_json_object", stats, F.concat(F.lit("$."), path))


def renders(shown: Column, stored: Column) -> Column:
    """Whether a number is shown as it is stored, thousands marked or not."""
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return bare(shown) == bare(stored)


def described(piece: Column, text: Column) -> Column:
    """Whether the parts of a description, between ellipses, stand in a text in their order."""
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    parts = F.filter(F.split(flat(piece), r"\.{3,}|…+"), lambda x: x != "")
    pattern = F.array_join(F.transform(parts, lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "(?s:.*?)")
    return (F.size(parts) > 0) & F.regexp_like(flat(text), pattern)


def markdown_sections(reports: DataFrame) -> DataFrame:
    """(doc_id, section_id, body) of reports (doc_id, body): what follows each heading of the second level, up to the next."""
    parts = F.slice(F.split("body", r"(?m)^##\s+"), 2, 1 << 20)
    each = reports.select("doc_id", F.explode(F.filter(parts, lambda x: x != "")).alias("part"))
    return each.select("doc_id", F.regexp_replace(F.regexp_extract("part", r"^(\S+)", 1), "[.．、]+$", "").alias("section_id"), strip(F.regexp_replace("part", r"^[^\n]*(?:\n|$)", "")).alias("body"))


def passage(text: Column, trigger: Column) -> Column:
    """The sentences around the first place where a trigger stands, whatever its case; null if it doesn't."""
    at = F.instr(F.lower(text), F.lower(trigger))
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(trigger), F.lit(1 << 30))
    start = F.regexp_extract(before, r"(?s)^.*[.!?][\"'”’]?\s+", 0)
    end = F.regexp_extract(after, r"(?s)^.*?[.!?][\"'”’]?(?=\s|$)|^.*$", 0)
    return F.when(at > 0, F.trim(F.concat(F.substring(before, F.length(start) + 1, F.lit(1 << 30)), F.substring(text, at, F.length(trigger)), end)))


def han_residuals(pairs: DataFrame, *keys: str) -> DataFrame:
    """Runs of Han characters in an English target, preserved tokens aside, that stand in the source; long ones call for action."""
    run = CJK + "{2,}"
    clean = F.regexp_replace("target", PRESERVED, " ")
    own = pairs.select(*keys, "source", F.explode(F.regexp_extract_all(clean, F.lit(run), F.lit(0))).alias("run")).filter(F.contains("source", "run"))
    return own.select(*keys, "run", F.when(F.length("run") >= 4, "actionable").otherwise("informational").alias("severity"))


def choose_cases(cases: DataFrame, *, limit: int = 3) -> DataFrame:
    """Per report of its cases (doc_id, case_id, linked, zone, pos): those that claims rest on, then the first of each zone, then the rest, in order."""
    c = F.col
    zone = F.row_number().over(Window.partitionBy("doc_id", "zone").orderBy("pos")) == 1
    rank = F.when(c("linked"), 0).when(c("zone_first"), F.array_position(F.array(*map(F.lit, ("beginning", "middle", "end"))), c("zone"))).otherwise(9)
    own = cases.withColumn("zone_first", zone).withColumn("rank", rank)
    return own.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "pos"))).filter(c("n") <= limit).select("doc_id", "case_id", "n", "linked")


def top_conflicts(rows: DataFrame, *, most: int = 20) -> DataFrame:
    """rows(term, pos), one for each conflict: the terms with most, those met first before others of as many."""
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("term", "n")


def coalesced(rows: DataFrame, defaults: dict[str, object], version: int) -> DataFrame:
    """Rows of an older state: missing columns and nulls get their defaults, and the version is the present one."""
    own = rows.select("*", *[F.lit(v).alias(c) for c, v in defaults.items() if c not in rows.columns])
    return own.fillna({c: v for c, v in defaults.items() if v is not None}).withColumn("version", F.lit(version))


def style(rows: DataFrame, *, known: tuple[str, ...] = ("general",), reasons: int = 4, domains: int = 6) -> DataFrame:
    """Recommended styles (recommended, confidence as text, reasons and domains as arrays) made sound: a known style, a confidence from 0 to 1, some reasons and
    domains that aren't blank; and an id of what is left."""
    some = lambda c, n: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: F.coalesce(x, F.lit("")) != ""), 1, n)
    confidence = F.least(F.greatest(F.coalesce(F.expr("try_cast(confidence AS DOUBLE)"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    own = rows.withColumn("recommended", F.when(F.col("recommended").isin(*known), F.col("recommended")).otherwise(known[0])).withColumn("confidence", confidence).withColumn("reasons", some(F.col("reasons"), reasons)).withColumn("domains", some(F.col("domains"), domains))
    return own.withColumn("style_id", F.substring(F.sha2(F.concat_ws("|", "recommended", F.array_join("reasons", ","), F.array_join("domains", ",")), 256), 1, 12))


def chapters(rows: DataFrame) -> DataFrame:
    """Configured chapters (report_id, pos from 1, section_id, title, and subsections as structs of heading_id, title, level) with their defaults; subsections without an
    id or a title go, and each gets the mark of its heading."""
    section = F.coalesce(F.nullif(_clean(F.col("section_id")), F.lit("")), F.col("pos").cast("string"))
    kept = F.filter("subsections", lambda x: (_clean(x["heading_id"]) != "") & (_clean(x["title"]) != ""))
    marked = F.transform(kept, lambda x: F.struct(_clean(x["heading_id"]).alias("heading_id"), _clean(x["title"]).alias("title"), F.repeat(F.lit("#"), F.coalesce(x["level"], F.lit(2)) + 1).alias("mark")))
    own = rows.withColumn("section_id", section).withColumn("subsections", F.coalesce(marked, F.array().cast("array<struct<heading_id:string,title:string,mark:string>>")))
    return own.withColumn("title", F.coalesce(F.nullif(_clean(F.col("title")), F.lit("")), F.concat(F.lit("Section "), "section_id")))
