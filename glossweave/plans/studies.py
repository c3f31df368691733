"""Queries over cases for study; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossweave.operators import cases
from glossweave.plans.catalogue import _G, _PAIRS, _SEG, _segments, query
from glossweave.sources import derived, jobs
from glossweave.sources.jobs import FINDING_SQL, RECORD_SQL

_BARE = r"lower(regexp_replace({}, '[\s\p{{P}}\p{{Z}}]+', '', 'g'))"
_WHOLE = r"lower(regexp_replace({}, '\s+', '', 'g'))"
_PADDED = r"(' ' || regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '  ', 'g') || ' ')"
_REVISED = f"coalesce({_WHOLE.format('initial_target')} <> '' AND {_WHOLE.format('target')} <> '' AND {_WHOLE.format('initial_target')} <> {_WHOLE.format('target')} AND {_BARE.format('initial_target')} <> {_BARE.format('target')}, false)"
#: Without the flag of running on into the next target, which takes a matcher that SQL hasn't; the derived targets don't.
_BASE = f"""WITH {_PAIRS}, {RECORD_SQL}, {FINDING_SQL}, {_G}, r1 AS (SELECT *, {_REVISED} AS revised, {_BARE.format('initial_target')} AS bi, {_BARE.format('target')} AS bf FROM rec),
r2 AS (SELECT *, revised AND length(bi) >= 8 AND (coalesce(contains(lag(bf) OVER w, bi), false) OR coalesce(contains(lead(bf) OVER w, bi), false)) AS flagged FROM r1 WINDOW w AS (PARTITION BY conv_id ORDER BY seg_idx)),
ff AS (SELECT conv_id, seg_idx, count(*) AS n_findings, count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'actionable') AS actionable, count(*) FILTER (WHERE severity = 'informational') AS informational,
bool_or(conflict) AS conflict, bool_or(coalesce(action = 'retranslated', false)) AS repair, bool_or(coalesce(action = 'human_fixed', false)) AS human FROM fd GROUP BY ALL),
pr AS (SELECT r2.*, coalesce(n_findings, 0) AS n_findings, coalesce(blocking, 0) AS blocking, coalesce(actionable, 0) AS actionable, coalesce(informational, 0) AS informational, coalesce(conflict, false) AS conflict, coalesce(repair, false) AS repair, coalesce(human, false) AS human,
(seg_idx + conv_id) % 3 AS used_terms FROM r2 LEFT JOIN ff USING (conv_id, seg_idx)),
sg AS (SELECT *, revised AND NOT flagged AS changed, blocking + actionable > 0 AS severe, 2 * (n_findings > 0)::INT + (revised AND NOT flagged)::INT + 2 * repair::INT + (used_terms > 0)::INT + (initial_target IS NOT NULL)::INT AS richness FROM pr),
t AS (SELECT *, (SELECT count(*) FROM g WHERE contains(lower(pr.source), lower(g.source))) AS terms, length(source) AS chars, len(regexp_extract_all({_PADDED.format('source')}, '(?i) (?:{cases.CLAUSES}) ')) AS clauses,
len(regexp_extract_all(source, '[,;:—–\\-()\\[\\]"“”‘’]')) AS marks, revised AND (repair OR human) AS repaired FROM pr),
fe AS (SELECT *, source <> '' AND n_findings > 0 AND repaired AS chain, regexp_matches(source, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:is|are|was|were|be|been|being)\\s+(?:[\\p{{L}}\\p{{N}}_]+\\s+){{0,2}}[\\p{{L}}\\p{{N}}_]+(?:ed|en)($|[^\\p{{L}}\\p{{N}}_])') AS passive, regexp_matches(source, '["“”‘’]|—|–') AS quoting FROM t),
sc AS (SELECT *, round(CASE WHEN chain THEN 40 ELSE 0 END + CASE WHEN blocking > 0 THEN 24 + least(blocking, 2) ELSE 0 END + CASE WHEN actionable > 0 THEN 20 + least(actionable, 3) ELSE 0 END + CASE WHEN repaired THEN 18 ELSE 0 END + CASE WHEN revised THEN 12 ELSE 0 END
+ CASE WHEN conflict THEN 5 ELSE 0 END + least(4.0, terms * 1.5) + CASE WHEN from_tm THEN 1 ELSE 0 END + CASE WHEN chars >= 180 THEN least(5.0, chars / 100) ELSE 0 END + CASE WHEN clauses >= 2 THEN least(4, clauses) ELSE 0 END + CASE WHEN marks >= 5 THEN least(3.0, marks / 3) ELSE 0 END
+ CASE WHEN passive THEN 1.5 ELSE 0 END + CASE WHEN quoting THEN 1 ELSE 0 END + CASE WHEN informational > 0 AND blocking + actionable = 0 THEN least(1.0, informational * 0.2) ELSE 0 END - CASE WHEN flagged THEN 100 ELSE 0 END, 3)::DOUBLE AS score FROM fe)"""


def _rows(spark, d):
    deal = derived.dealt_by(derived.table(spark, d, "conversations"))
    # findings meet the pairs where the pairs were joined; then each conversation's lie together for their windows
    found = cases.process(jobs.records(spark, d, deal=deal), jobs.findings(spark, d))
    return cases.integrity_flags(found, deal=deal).withColumn("used_terms", (F.col("seg_idx") + F.col("conv_id")) % 3)


def _scored(spark, d):
    return cases.features(_rows(spark, d), derived.glossary(spark))


@query(f"{_BASE} SELECT conv_id, seg_idx, revised, CASE WHEN flagged THEN 'probable_adjacent_initial_target_overlap' ELSE '' END AS flags, revised AND NOT flagged AS eligible FROM r2")
def revision_cases(spark, d):
    own = cases.integrity_flags(jobs.records(spark, d))
    return own.select("conv_id", "seg_idx", "revised", F.array_join("flags", ",").alias("flags"), (F.col("revised") & (F.size("flags") == 0)).alias("eligible"))


@query(f"{_BASE} SELECT conv_id, seg_idx, score, terms, clauses, marks, chars, repaired, chain FROM sc")
def case_features(spark, d):
    return _scored(spark, d).select("conv_id", "seg_idx", "score", "terms", "clauses", "marks", "chars", "repaired", "chain")


@query(f"""{_BASE}, z AS (SELECT *, CASE WHEN seg_idx / greatest(max(seg_idx) OVER (PARTITION BY conv_id), 1) < 1 / 3 THEN 'beginning' WHEN seg_idx / greatest(max(seg_idx) OVER (PARTITION BY conv_id), 1) < 2 / 3 THEN 'middle' ELSE 'end' END AS zone FROM sc),
b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, zone ORDER BY score DESC, seg_idx) > 3)::INT AS late FROM z WHERE revised), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY late, score DESC, seg_idx) AS rank FROM b WHERE late = 0 OR score > 0)
SELECT conv_id, seg_idx, zone, score, CASE WHEN flagged THEN 'review_required' ELSE 'eligible' END AS status FROM n WHERE rank <= 80""")
def mined_cases(spark, d):
    return cases.mine(_scored(spark, d)).select("conv_id", "seg_idx", "zone", "score", "status")


@query(f"""{_BASE}, a AS (SELECT conv_id, count(*) AS total_segments, count(*) FILTER (WHERE reviewed) AS reviewed_segments, count(*) FILTER (WHERE initial_target IS NOT NULL) AS with_versions, count(*) FILTER (WHERE revised) AS revised_segments,
count(*) FILTER (WHERE initial_target IS NOT NULL AND NOT revised) AS unchanged_segments, count(*) FILTER (WHERE revised AND n_findings > 0) AS revised_with_findings, count(*) FILTER (WHERE revised AND repair) AS revised_with_repairs, count(*) FILTER (WHERE chain) AS complete_chains,
count(*) FILTER (WHERE revised AND NOT flagged) AS eligible_revisions, count(*) FILTER (WHERE from_tm) AS tm_reuse FROM fe GROUP BY conv_id),
b AS (SELECT conv_id, count(*) FILTER (WHERE NOT resolved AND severity = 'blocking') AS blocking_findings, count(*) FILTER (WHERE severity = 'blocking') AS recorded_blocking, count(*) FILTER (WHERE conflict) AS term_conflicts,
string_agg(DISTINCT type, ',' ORDER BY type) FILTER (WHERE NOT resolved) AS open_types FROM fd GROUP BY conv_id)
SELECT a.*, coalesce(blocking_findings, 0) AS blocking_findings, coalesce(recorded_blocking, 0) AS recorded_blocking, coalesce(term_conflicts, 0) AS term_conflicts, coalesce(open_types, '') AS open_types FROM a LEFT JOIN b USING (conv_id)""")
def project_statistics(spark, d):
    rows = cases.features(_rows(spark, d), None)
    n = lambda x, name: F.count_if(F.expr(x)).alias(name)
    per = rows.groupBy("conv_id").agg(
        F.count("*").alias("total_segments"), n("reviewed", "reviewed_segments"), n("initial_target IS NOT NULL", "with_versions"), n("revised", "revised_segments"), n("initial_target IS NOT NULL AND NOT revised", "unchanged_segments"),
        n("revised AND n_findings > 0", "revised_with_findings"), n("revised AND repair", "revised_with_repairs"), n("chain", "complete_chains"), n("revised AND size(flags) = 0", "eligible_revisions"), n("from_tm", "tm_reuse"),
    )
    open_types = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("resolved"), F.col("type")))), ",")
    found = jobs.findings(spark, d).groupBy("conv_id").agg(n("NOT resolved AND severity = 'blocking'", "blocking_findings"), n("severity = 'blocking'", "recorded_blocking"), n("conflict", "term_conflicts"), open_types.alias("open_types"))
    return per.join(found, "conv_id", "left").fillna({"blocking_findings": 0, "recorded_blocking": 0, "term_conflicts": 0, "open_types": ""})


_CLASS = "CASE WHEN NOT ((conv_id + seg_idx) % 5 <> 0) THEN 'misaligned_case' WHEN NOT changed THEN 'weak_case' WHEN richness >= 5 AND severe THEN 'strong_case' ELSE 'usable_case' END"


@query(f"{_BASE} SELECT conv_id, seg_idx, richness, {_CLASS} AS class FROM sg")
def case_quality(spark, d):
    return cases.signals(_rows(spark, d)).select("conv_id", "seg_idx", "richness", cases.case_class((F.col("conv_id") + F.col("seg_idx")) % 5 != 0).alias("class"))


@query(f"{_BASE} SELECT {_CLASS} AS class, count(*) AS n, max(richness) AS richest FROM sg GROUP BY 1")
def case_class_counts(spark, d):
    own = cases.signals(_rows(spark, d)).withColumn("class", cases.case_class((F.col("conv_id") + F.col("seg_idx")) % 5 != 0))
    return own.groupBy("class").agg(F.count("*").alias("n"), F.max("richness").alias("richest"))


@query(f"""{_BASE} SELECT conv_id, seg_idx, CASE WHEN NOT changed THEN 'source_final_only' WHEN repair AND (severe OR used_terms > 0) THEN 'rich_process_evidence' ELSE 'partial_process_evidence' END AS level,
CASE WHEN NOT changed THEN 'textual_analysis' WHEN repair AND severe THEN 'textual_analysis,translation_decision,revision_reasoning,error_repair_analysis' WHEN repair AND used_terms > 0 THEN 'textual_analysis,translation_decision,revision_reasoning' ELSE 'textual_analysis,translation_decision,limited_process_inference' END AS can,
CASE WHEN NOT changed THEN 'historical_revision_reasoning,initial_failure_reasoning,process_claims,revision_case_analysis' WHEN repair AND severe THEN '' WHEN repair AND used_terms > 0 THEN 'error_repair_analysis' ELSE 'historical_revision_reasoning' END AS cannot FROM sg""")
def evidence_adequacy(spark, d):
    own = cases.adequacy(cases.signals(_rows(spark, d)))
    return own.select("conv_id", "seg_idx", "level", F.array_join("can", ",").alias("can"), F.array_join("cannot", ",").alias("cannot"))


@query(f"""{_BASE}, k AS (SELECT conv_id, seg_idx, richness, changed, seg_idx = 0 AS selected, seg_idx % 3 AS relevance, length(source) AS score FROM sg)
SELECT conv_id, seg_idx, replacement FROM (SELECT o.conv_id, o.seg_idx, n.seg_idx AS replacement, row_number() OVER (PARTITION BY o.conv_id, o.seg_idx ORDER BY n.richness DESC, n.relevance DESC, n.score DESC, n.seg_idx) AS r
FROM k o JOIN k n ON o.conv_id = n.conv_id AND o.selected AND NOT n.selected AND n.changed AND n.richness >= 3 AND n.richness > o.richness) WHERE r = 1""")
def case_replacements(spark, d):
    own = cases.signals(_rows(spark, d)).select("conv_id", "seg_idx", "richness", F.col("changed").alias("eligible"), (F.col("seg_idx") == 0).alias("selected"), (F.col("seg_idx") % 3).alias("relevance"), F.length("source").alias("score"))
    return cases.replacements(own)


_WORD = lambda words: rf"regexp_matches({_PADDED.format('text')}, '(?i) (?:{words}) ')"
_NAMED = ", ".join(f"CASE WHEN {_WORD(words)} THEN '{name}' END" for name, words in cases.SIGNALS.items()).replace("no longer", "no  longer")
_SIGNALS = rf"""sn AS (SELECT doc_id, seg_idx, text, list_filter([{_NAMED}, CASE WHEN regexp_matches(text, '[—–:;]|[“”"]') THEN 'information_structure' END, CASE WHEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+($|[^\p{{L}}\p{{N}}_])') THEN 'proper_noun' END,
CASE WHEN length(text) >= 100 AND length(text) - length(replace(text, ',', '')) >= 2 THEN 'multi_clause_structure' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])[A-Za-z]+(?:ed|ing)\s+(?:at|for|from|into|of|off|on|out|over|to|up|with)($|[^\p{{L}}\p{{N}}_])') THEN 'lexical_or_idiomatic_phrase' END], lambda x: x IS NOT NULL) AS signals FROM seg)"""


@query(f"WITH {_SEG}, {_SIGNALS} SELECT unnest(signals) AS signal, count(*) AS n, min(doc_id) AS first_doc FROM sn GROUP BY 1")
def screening_signals(spark, d):
    return _segments(spark, d).select("doc_id", F.explode(cases.screening(F.col("text"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH {_SEG}, {_SIGNALS}, c AS (SELECT *, length(text) AS n, substring(lag(text) OVER w, 1, 500) AS before, substring(lead(text) OVER w, 1, 500) AS after,
CASE WHEN seg_idx / greatest(max(seg_idx) OVER (PARTITION BY doc_id), 1) < 1 / 3 THEN 1 WHEN seg_idx / greatest(max(seg_idx) OVER (PARTITION BY doc_id), 1) < 2 / 3 THEN 2 ELSE 3 END AS zone FROM sn WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, zone ORDER BY len(signals) DESC, least(n, 300) DESC, seg_idx) > 1 AS late FROM c WHERE len(signals) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late, len(signals) DESC, least(n, 300) DESC, seg_idx) AS rank FROM l)
SELECT doc_id, seg_idx, substring(text, 1, 1200) AS source, before, after, array_to_string(signals, ',') AS signals FROM r WHERE rank <= 12""")
def bounded_source_pool(spark, d):
    return cases.source_pool(_segments(spark, d), most=12).withColumn("signals", F.array_join("signals", ","))
