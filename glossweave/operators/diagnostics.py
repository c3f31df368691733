"""Diagnostics of a report's quality: roles of paragraphs, questions and claims, use of evidence, repeats, and findings in order of urgency.

Sections are (doc_id, seg_idx, body); plans and references are edges as in ``reports``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossweave.operators.chain import Deal, as_they_are
from glossweave.operators.records import described
from glossweave.operators.reports import KEY, MARKERS, references

# Phrases that say nothing of their own, and signals of what a paragraph does.
GENERIC = {
    "realization_opening": "通过本次翻译实践[,，]?笔者(?:深刻|进一步|更加)?(?:地)?认识到", "future_reference": "为今后的翻译实践(?:提供了?)?(?:参考|借鉴|启示)", "quality_gain_claim": "这不(?:仅|但)(?:提高|提升)了翻译质量[,，]?也(?:为|对)今后的翻译实践",
    "comprehensive_factors": "在翻译过程中[,，]?需要综合考虑多种因素", "strategy_effectiveness": "该策略有效提升了译文的(?:准确性和可读性|质量)", "summary_boilerplate": "综上所述[,，]?笔者(?:认为|相信|希望)", "continuous_practice": "随着翻译实践的不断深入",
    "eng_realization": "through this translation practice[,]? the (?:author|translator) (?:deeply )?realized", "eng_future": "provide[ds]? (?:valuable )?(?:reference|insights) for future translation",
    "eng_quality_gain": "not only improves translation quality,? but also", "eng_generic_conclusion": "in conclusion[,]? the translator (?:believes|hopes)",
}
ANALYSIS = "(?i)从结果看可解释为|这说明|这表明|原因在于|可归因于|体现了|反映了|并非(?:简单|仅)|相较于|替代方案|权衡|局限|外推|this suggests|this indicates|can be explained|rather than|trade-off|limitation"
TRANSITION = "^(?:接下来|下面|首先|其次|最后|综上|此外|另一方面|值得注意的是)"
SUMMARY = "本节(?:总结|小结)|综上所述|总体而言|概括而言|本节主要(?:分析|讨论)"
FILLER = "^(?:在此|这里|本文|本报告|笔者)将(?:对|从|结合)"
DESCRIPTION = "译文(?:将|把|对|中)|(?:译为|译作|处理为|调整为)|the translation (?:renders|turns|handles)"
THEORY = "功能对等|目的论|关联理论|翻译转换|等值|functional equivalence|skopos|relevance theory"
EFFECT = "(?:提高|提升)(?:了)?(?:译文|翻译|文本)?的?(?:可读性|准确性|自然度|流畅性)|(?:使|让|令)译文(?:更加|更|更为)?(?:自然|准确|流畅|通顺|易懂)|(?:improve[ds]?|enhance[ds]?|increase[ds]?)(?: the)? (?:readability|accuracy|naturalness|fluency)"
STRATEGY = "(?:采用了|运用了|使用|采取)(?:了)?(?:直译|意译|增译|省译|转换|拆分|重组|语序调整|音译)(?:的)?策略"
PROCESS = "(?:译者|笔者)(?:最初|首先|一开始|曾)(?:考虑|尝试|选择|认为)|(?:机器翻译|初译)(?:失败|错误|无法)(?:因为|由于)|the (?:translator|author) (?:initially|first) (?:considered|tried|chose)"
RULE = "因此[,，]?(?:在|对于)?(?:文学|商务|科技|法律)?翻译中(?:应当|需要|必须|应)|hence,? (?:in )?(?:literary|legal|technical) translation (?:should|must|needs)"
DIMENSION = "语义|逻辑|指称|信息结构|语域|节奏|叙事|语用|文化|术语|semantic|logical|reference|register|rhythm|narrative|pragmatic|cultural|terminolog"
REVISION = "(?s)修改后|修订后|经过(?:人工)?修订|初译.{0,120}(?:终译|最终译文|最终).{0,80}(?:改|调整|修订|替换|变)|(?:从|将)[“\"'].*?[”\"'].{0,20}(?:改|调整|修订|替换)(?:成|为)[“\"'].*?[”\"']"
REVISION_PAIR = "(?s)(?:从|将)[“\"']([^”\"']{1,160})[”\"'].{0,20}(?:改|调整|修订|替换)(?:成|为)[“\"']([^”\"']{1,160})[”\"']"
PRIORITIES, SEVERITIES = ("P0", "P1", "P2", "P3"), ("critical", "high", "medium", "low")


def generic_patterns(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in GENERIC.items()]))


def role(text: Column) -> Column:
    """What a paragraph does; the first that fits of ten roles."""
    x = F.trim(text)
    marked = lambda *kinds: reduce(Column.__or__, [x.rlike(MARKERS[k]) for k in kinds])
    quoted = r"(?m)^\s*>\s*\[(?:SOURCE|TARGET|LITERATURE)\s+[^\]]+\]:|<!--stat:[A-Za-z0-9_.-]+-->"
    return (
        F.when(x == "", "filler").when(marked("claim", "rq", "lit_claim"), "claim").when(marked("case", "lit_evidence") | x.rlike(quoted), "evidence").when(x.rlike("|".join(GENERIC.values())), "generic").when(x.rlike(SUMMARY), "summary")
        .when(x.rlike(TRANSITION), "transition").when(x.rlike(THEORY) & x.rlike(ANALYSIS), "theoretical_interpretation").when(x.rlike(DESCRIPTION), "translation_description").when(x.rlike(ANALYSIS), "analysis")
        .when((F.length(x) < 40) | x.rlike(FILLER), "filler").otherwise("background")
    )


def paragraphs(sections: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, n, paragraph): parts between blank lines that aren't blank."""
    parts = F.filter(F.split("body", r"\n\s*\n"), lambda x: F.trim(x) != "")
    return sections.select(*KEY, F.posexplode(parts).alias("n", "paragraph"))


def role_counts(sections: DataFrame) -> DataFrame:
    """Paragraphs of each role, by report and in all (doc_id null), with the role's share."""
    each = paragraphs(sections).select("doc_id", role(F.col("paragraph")).alias("role"))
    counts = each.rollup("role", "doc_id").count().filter("role IS NOT NULL").select("doc_id", "role", F.col("count").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.withColumn("share", F.round(F.col("n") / total, 3))


def unsupported(sections: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, type, hit): phrases that assert without a mechanism, a dimension or a record in the text around them."""
    body = F.col("body")
    found = {
        "strategy_label_without_mechanism": F.filter(windows(body, STRATEGY, 40, 80), lambda x: x["window"].rlike(EFFECT)), "unsupported_quality_effect": F.filter(windows(body, EFFECT, 60, 60), lambda x: ~x["window"].rlike(DIMENSION)),
        "unsupported_process_claim": F.filter(windows(body, PROCESS, 40, 120), lambda x: ~(F.contains(x["window"], F.lit("<!--")) & F.contains(x["window"], F.lit("finding")))), "case_to_general_rule_overreach": windows(body, RULE, 50, 60),
    }
    hits = F.flatten(F.array(*[F.transform(x, _named(kind)) for kind, x in found.items()]))
    own = sections.filter(body.rlike("|".join((STRATEGY, EFFECT, PROCESS, RULE))))
    return own.select(*KEY, F.explode(hits).alias("h")).select(*KEY, "h.type", F.substring(squeezed(F.col("h.hit")), 1, 160).alias("hit"))


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def windows(text: Column, pattern: str, before: int, after: int) -> Column:
    """Of every match, in order: the match, and it with the text around it. Windows of matches that are near overlap."""
    matches, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)

    def one(m: Column, i: Column) -> Column:
        start = F.length(F.array_join(F.slice(between, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(matches, F.lit(1), i), ""))
        first = F.greatest(start - before, F.lit(0))
        return F.struct(m.alias("match"), F.substring(text, first + 1, start + F.length(m) + after - first).alias("window"))

    return F.transform(matches, one)


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), (F.concat_ws(" ", x["match"], x["window"]) if kind.startswith("strategy") else x["window"]).alias("hit"))


def revision_claims(sections: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, n, claim, old, new): where a section says that something was revised, and from what to what, if it quotes both."""
    found = sections.filter(F.col("body").rlike(REVISION)).select(*KEY, F.posexplode(windows(F.col("body"), REVISION, 80, 120)).alias("n", "w"))
    part = lambda k: F.when(F.col("w.window").rlike(REVISION_PAIR), squeezed(F.regexp_extract("w.window", REVISION_PAIR, k)))
    return found.select(*KEY, "n", F.substring(squeezed(F.col("w.window")), 1, 300).alias("claim"), part(1).alias("old"), part(2).alias("new"))


def described_revisions(sections: DataFrame, plan: DataFrame, cases: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, type, ref) of what a section says of revisions and the records don't bear out.

    plan(doc_id, seg_idx, case_id); cases(doc_id, case_id, initial_target, target, eligible), and synthetic ones (doc_id, case_id, baseline, optimized). A case counts where
    the section plans it and names it. A case that wasn't revised may not stand with a claim of revision; and a quoted change must be that of a revised case, or of a synthetic one."""
    claims = revision_claims(sections)
    holding = sections.join(claims.select(*KEY).distinct(), KEY, "left_semi")
    named = plan.join(holding, KEY).filter(F.contains("body", "case_id")).select(*KEY, "case_id").distinct()
    own = named.join(cases, ["doc_id", "case_id"])
    invented = own.filter(~F.col("eligible")).select(*KEY, F.lit("invented_revision").alias("type"), F.col("case_id").alias("ref"))
    pairs = claims.filter("old <> '' AND new <> ''").select(*KEY, "n", "old", "new")
    clean = lambda c: squeezed(F.coalesce(c, F.lit("")))
    stored = pairs.join(own.filter("eligible"), KEY).filter(F.contains(clean(F.col("initial_target")), F.col("old")) & F.contains(clean(F.col("target")), F.col("new"))).select(*KEY, "n")
    made = pairs.join(named.join(synthetic, ["doc_id", "case_id"]), KEY).filter(described(F.col("old"), F.col("baseline")) & described(F.col("new"), F.col("optimized"))).select(*KEY, "n")
    lost = pairs.join(own.select(*KEY).distinct(), KEY, "left_semi").join(stored.unionByName(made).distinct(), [*KEY, "n"], "left_anti")
    return invented.unionByName(lost.select(*KEY, F.lit("described_revision_not_in_stored_delta").alias("type"), F.concat("old", F.lit("→"), "new").alias("ref")))


def question_matrix(plan: DataFrame, questions: DataFrame, claims: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """Per report and question (doc_id, rq): how many claims answer to it and how many sections develop it; ``claims`` (claim_id, rq)."""
    planned = deal(plan.filter("kind = 'claim'").select("doc_id", F.col("ref").alias("claim_id")), "doc_id").distinct().join(claims, "claim_id").select("doc_id", "rq")
    planned = deal(planned, "doc_id", "rq").groupBy("doc_id", "rq").agg(F.count("*").alias("n_claims"))
    developed = deal(plan.filter("kind = 'rq'").select("doc_id", F.col("ref").alias("rq"), "seg_idx"), "doc_id", "rq").distinct().groupBy("doc_id", "rq").agg(F.count("*").alias("n_sections"))
    both = deal(questions, "doc_id", "rq").join(planned, ["doc_id", "rq"], "left").join(developed, ["doc_id", "rq"], "left").fillna({"n_claims": 0, "n_sections": 0})
    reason = F.when(F.col("n_claims") == 0, "no_claim").when(F.col("n_sections") == 0, "no_section")
    return both.withColumn("answered", reason.isNull()).withColumn("reason", reason)


def repeats(sections: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """(doc_id, type, ref, n): paragraphs that stand in several sections, and cases and claims that several sections name."""
    text = F.substring(F.trim(F.regexp_replace("paragraph", r"\s+", " ")), 1, 400)
    same = deal(paragraphs(sections).select("doc_id", "seg_idx", F.sha2(text, 256).alias("ref")), "doc_id", "ref").groupBy("doc_id", "ref").agg(F.countDistinct("seg_idx").alias("n")).filter("n > 1").withColumn("type", F.lit("duplicate_paragraph"))
    named = references(sections).filter("kind IN ('case', 'synthetic', 'claim')").withColumn("type", F.when(F.col("kind") == "claim", "duplicate_claim").otherwise("duplicate_case_analysis"))
    often = deal(named, "doc_id", "type", "ref").groupBy("doc_id", "type", "ref").agg(F.countDistinct("seg_idx").alias("n")).filter("n > 1")
    return same.unionByName(often, allowMissingColumns=True)


def untraced(sections: DataFrame, *, last: Column | None = None) -> DataFrame:
    """Sentences of a report's last section that no marker in their paragraph ties to evidence; (doc_id, seg_idx, sentence). Where the rows say which section is the ``last``, no text moves."""
    ends = sections.filter(last) if last is not None else sections.join(sections.groupBy("doc_id").agg(F.max("seg_idx").alias("seg_idx")), KEY)
    own = paragraphs(ends).filter(~F.col("paragraph").rlike(r"^\s*#{1,6}\s+"))
    bare = reduce(Column.__and__, [~F.col("paragraph").rlike(MARKERS[k]) for k in ("claim", "rq", "case", "source", "lit_claim")]) & ~F.col("paragraph").rlike("<!--(?:stat|cite):")
    sentence = F.trim(F.regexp_replace("s", r"\s+", " "))
    each = own.filter(bare).select(*KEY, F.explode(F.split(F.regexp_replace("paragraph", "(?s)<!--.*?-->", ""), r"(?<=[。！？；!?;])\s*")).alias("s")).select(*KEY, sentence.alias("sentence"))
    return each.filter(F.length("sentence") >= 12).withColumn("sentence", F.substring("sentence", 1, 160))


def unused_evidence(cases: DataFrame, sections: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """cases(doc_id, ref, severe, changed, repair, terms): whether the report uses each, and what of worth an unused one has."""
    used = deal(references(sections).filter("kind IN ('case', 'synthetic')").select("doc_id", "ref"), "doc_id", "ref").distinct().withColumn("used", F.lit(True))
    own = cases.join(used, ["doc_id", "ref"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    worth = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("severe", "changed", "repair", "terms")]))
    return own.withColumn("unused", F.when(F.col("used"), F.array().cast("array<string>")).otherwise(worth)).withColumn("high_value_unused", F.size("unused") > 0)


def diagnosed(matrix: DataFrame, plan: DataFrame, claims: DataFrame, sections: DataFrame, cases: DataFrame, utilisation: DataFrame, trace: DataFrame, repeated: DataFrame, assertions: DataFrame, *, literature: bool, deal: Deal = as_they_are) -> DataFrame:
    """Findings that the diagnostics of reports give, (doc_id, type, dimension, severity, priority, section_id, claim_id, case_id, repair_action, evidence, pos).

    matrix as of ``question_matrix``; plan(doc_id, seg_idx, kind, ref); claims(doc_id, claim_id) of all reports; sections(doc_id, seg_idx, body); cases(doc_id, case_id, class, synthetic, revision); and what
    ``unused_evidence``, ``untraced``, ``repeats`` and ``unsupported`` give. Without ``literature`` a theory's name is a finding too. ``pos`` tells findings of one kind apart."""
    c = F.col
    section = F.concat(F.lit("s"), "seg_idx")

    def rule(df: DataFrame, kind: str | Column, dimension: str | Column, severity: str | Column, priority: str | Column, *, section_id: Column | None = None, claim_id: str | None = None, case_id: str | None = None, action: str = "rewrite", evidence: Column | None = None) -> DataFrame:
        col = lambda x: x if isinstance(x, Column) else F.lit(x)
        text = lambda x: F.lit(None).cast("string") if x is None else (x if isinstance(x, Column) else c(x)).cast("string")
        out = df.select("doc_id", col(kind).alias("type"), col(dimension).alias("dimension"), col(severity).alias("severity"), col(priority).alias("priority"), text(section_id).alias("section_id"), text(claim_id).alias("claim_id"), text(case_id).alias("case_id"), F.lit(action).alias("repair_action"), text(evidence).alias("evidence"))
        return out.withColumn("pos", F.concat_ws("|", "type", "section_id", "claim_id", "case_id", "evidence"))

    placed = deal(plan.filter("kind = 'claim'").select("doc_id", c("ref").alias("claim_id")), "doc_id", "claim_id").distinct()
    asked = deal(plan.filter("kind = 'rq'").select(*KEY), *KEY).distinct()
    of_case = (
        F.when(c("synthetic") & (c("class") == "weak_case"), "ineligible_synthetic_case_used").when(~c("synthetic") & ~c("revision"), "non_revision_case_used_as_revision_analysis")
        .when(c("class").isin("weak_case", "redundant_case", "misaligned_case"), c("class"))
    )
    bad = cases.withColumn("kind", of_case).filter("kind IS NOT NULL")
    kind = c("kind")
    grave = kind.isin("ineligible_synthetic_case_used", "non_revision_case_used_as_revision_analysis")
    asserted = F.when(c("type") == "case_to_general_rule_overreach", "conclusion_discipline").otherwise("analysis_depth")
    again = F.when(c("type") == "duplicate_case_analysis", "medium").otherwise("low")
    ref = lambda t: F.when(c("type") == t, c("ref"))
    theories = sections.select(*KEY, F.explode(F.regexp_extract_all("body", F.lit(f"({THEORY})"), F.lit(1))).alias("hit"))
    return reduce(
        DataFrame.unionByName,
        (
            rule(matrix.filter(~c("answered")), "research_question_unanswered", "research_alignment", "high", "P1", claim_id="rq"), rule(deal(claims, "doc_id", "claim_id").join(placed, ["doc_id", "claim_id"], "left_anti"), "orphan_claim", "research_alignment", "medium", "P1", claim_id="claim_id"),
            rule(deal(sections.select(*KEY), *KEY).join(asked, KEY, "left_anti"), "section_without_research_question", "research_alignment", "low", "P3", section_id=section),
            rule(bad, kind, F.when(kind == "redundant_case", "redundancy").otherwise("case_quality"), F.when(grave, "critical").when(kind == "misaligned_case", "high").otherwise("medium"), F.when(grave | (kind == "misaligned_case"), "P1").otherwise("P2"), case_id="case_id", action="replace_case"),
            rule(utilisation.filter("high_value_unused"), "high_value_evidence_unused", "evidence_utilization", "medium", "P2", case_id="ref"), rule(trace, "conclusion_without_trace", "conclusion_discipline", "low", "P3", section_id=section, evidence=c("sentence")),
            rule(repeated, c("type"), "cross_section_coherence", again, "P2", claim_id=ref("duplicate_claim"), case_id=ref("duplicate_case_analysis"), evidence=ref("duplicate_paragraph")),
            rule(assertions, c("type"), asserted, F.when(c("type") == "unsupported_process_claim", "high").otherwise("medium"), F.when(c("type") == "unsupported_quality_effect", "P2").otherwise("P1"), section_id=section, evidence=c("hit")),
            rule(theories.limit(0) if literature else theories, "theory_name_dropping", "theory_case_fit", "medium", "P1", section_id=section, evidence=c("hit")),
        ),
    )


def counted(findings: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """(type, priority, severity, n, n_docs): findings of each kind, and the reports that have some. Each report's are counted first, so that no task holds all reports of a kind."""
    kind = ["type", "priority", "severity"]
    each = deal(findings.select(*kind, "doc_id"), *kind, "doc_id").groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy(*kind).agg(F.sum("n").alias("n"), F.count("doc_id").alias("n_docs"))


def prioritized(findings: DataFrame, *, prefix: str = "AQ") -> DataFrame:
    """Per report, numbered in the order of priority, severity, section and case; unknown values come last."""
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names)))
    order = Window.partitionBy("doc_id").orderBy(place("priority", PRIORITIES), place("severity", SEVERITIES), F.coalesce("section_id", F.lit("")), F.coalesce("case_id", F.lit("")), "pos")
    return findings.withColumn("issue_id", F.format_string(f"{prefix}-%03d", F.row_number().over(order)))


def normalized(findings: DataFrame, known: DataFrame, *, dimensions: tuple[str, ...], actions: tuple[str, ...]) -> DataFrame:
    """A model's findings made safe: unknown dimensions and findings without a reason go, severities, priorities and actions get known values,
    ids that aren't ``known`` (kind, ref) become null, and a replacement without a case becomes a rewrite."""
    c = F.col
    own = findings.filter(c("dimension").isin(*dimensions) & (F.trim("reason") != ""))
    for kind, name in (("section", "section_id"), ("claim", "claim_id"), ("case", "case_id")):
        own = own.join(known.filter(c("kind") == kind).select(c("ref").alias(name), F.lit(True).alias(f"__{kind}")), name, "left").withColumn(name, F.when(c(f"__{kind}"), c(name))).drop(f"__{kind}")
    severity, priority = F.lower(F.coalesce("severity", F.lit("medium"))), F.upper(F.coalesce("priority", F.lit("P2")))
    action = F.when(c("repair_action").isin(*actions), c("repair_action")).otherwise("rewrite")
    return own.withColumn("severity", F.when(severity.isin(*SEVERITIES), severity).otherwise("medium")).withColumn("priority", F.when(priority.isin(*PRIORITIES), priority).otherwise("P2")).withColumn("repair_action", F.when((action == "replace_case") & c("case_id").isNull(), "rewrite").otherwise(action))


def repair_plan(findings: DataFrame) -> DataFrame:
    """Findings worth repair, each with the unit to repair: its case if that is to be replaced, else its section; those without either go."""
    c = F.col
    replace = (c("repair_action") == "replace_case") & c("case_id").isNotNull()
    unit = F.when(replace, F.concat(F.lit("case:"), "case_id")).when(c("section_id").isNotNull(), F.concat(F.lit("section:"), "section_id"))
    action = F.when(~replace & (c("repair_action") == "replace_case"), "rewrite").otherwise(c("repair_action"))
    return findings.filter(c("priority").isin("P0", "P1", "P2")).withColumn("unit", unit).filter("unit IS NOT NULL").withColumn("repair_action", action)


def replaced(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges`` (.., case_id) with the cases of ``mapping`` (old_id, new_id) in place of theirs."""
    return edges.join(mapping, F.col("case_id") == F.col("old_id"), "left").withColumn("case_id", F.coalesce("new_id", "case_id")).drop("old_id", "new_id")
