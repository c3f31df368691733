"""Rules over translation pairs that give any number of findings each, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.functions.text import CJK, PRESERVED, folded, incomplete, preserved_kind, preserved_tokens, strip, term_matches, words
from glossweave.operators.matching import term_matches_in

KEYS = ("arm", "conv_id", "seg_idx")


#: Words that may stand in both texts. Fixed value.
ALLOWED = ("mti",)


def _finding(kind: str, severity: Column, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), reason.alias("reason"))


def residual_runs(source: Column, target: Column) -> Column:
    """Runs of words of five letters or more in the target that the source has too, as islands between other such words; what must survive unchanged is no word."""
    known = F.transform(words(source, 5), lambda w: F.lower(w))
    own = words(F.regexp_replace(target, PRESERVED, " "), 5)
    marked = F.transform(own, lambda w: F.when(F.array_contains(known, F.lower(w)) & ~F.lower(w).isin(*ALLOWED), w).otherwise("|"))
    return F.filter(F.split(F.array_join(marked, " "), r" ?\|[| ]*"), lambda x: x != "")


def han_runs(source: Column, target: Column) -> Column:
    """Runs of Han characters in an English target that stand in the source."""
    own = F.regexp_extract_all(F.regexp_replace(target, PRESERVED, " "), F.lit(CJK + "{2,}"), F.lit(0))
    return F.filter(own, lambda x: F.contains(source, x))


def findings(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(arm, conv_id, seg_idx, type, severity, reason); ``terms`` has its term as term_source. A blank target has no finding but that it is blank.

    ``pairs`` may have a ``target_lang``; without one targets aren't English. What a pair tells by itself is found in one pass over the pairs; terms of the
    source and forbidden forms of the target by an automaton each, a second and a third."""
    own = pairs if "target_lang" in pairs.columns else pairs.withColumn("target_lang", F.lit(None).cast("string"))
    own = own.select(*KEYS, "source", F.coalesce("target", F.lit("")).alias("target"), (F.coalesce("target_lang", F.lit("")) == "English").alias("english"))
    blank = strip(F.col("target")) == ""
    source, target, english = F.col("source"), F.col("target"), F.col("english")
    lit = F.lit
    none = F.array().cast("array<struct<type:string,severity:string,reason:string>>")
    identical = ~english & (F.size(words(source)) >= 2) & (folded(source) == folded(target))
    lost = F.filter(preserved_tokens(source), lambda t: ~F.contains(target, t))
    lost = F.transform(lost, lambda t: _finding("token_lost", F.when(preserved_kind(t) == "placeholder", "blocking").otherwise("actionable"), t))
    han = F.transform(han_runs(source, target), lambda x: _finding("residual", F.when(F.length(x) >= 4, "actionable").otherwise("informational"), x))
    latin = F.transform(residual_runs(source, target), lambda x: _finding("residual", F.when(F.contains(x, lit(" ")), "actionable").otherwise("informational"), x))
    told = F.concat(
        F.when(incomplete(source, target), F.array(_finding("incomplete", lit("blocking"), lit("")))).otherwise(none), F.when(identical, F.array(_finding("identical", lit("actionable"), lit("")))).otherwise(none),
        F.coalesce(lost, none), F.coalesce(F.when(english, han).otherwise(latin), none),
    )
    each = own.select(*KEYS, F.explode(F.when(blank, F.array(_finding("blank", lit("blocking"), lit("")))).otherwise(told)).alias("f"), source.alias("__source"))
    # a whole source that a locked entry preserves may stand as it is
    kept_whole = terms.filter("status = 'locked' AND behavior = 'preserve'").select(folded(F.col("term_source")).alias("__whole")).distinct()
    each = each.withColumn("__fold", F.when(F.col("f.type") == "identical", folded(F.col("__source")))).drop("__source").join(kept_whole, F.col("__fold") == F.col("__whole"), "left_anti").select(*KEYS, "f.*")
    locked = terms.filter("status = 'locked'")
    full = own.filter(~blank)
    in_source = term_matches_in(full, locked, text_col="source", term_col="term_source", keep=[*KEYS, "target"])
    preserve = F.col("behavior") == "preserve"
    missing = ~preserve & (F.col("preferred") != "") & ~term_matches(F.col("preferred"), F.col("target"))
    unkept = preserve & ~F.contains("target", "term_source")
    name = F.when(unkept & F.col("term_source").rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-]{1,}$"), "blocking").otherwise("actionable")
    of_terms = in_source.filter(missing | unkept).select(*KEYS, F.when(unkept, "preserve_lost").otherwise("term_missing").alias("type"), name.alias("severity"), F.col("id").alias("reason"))
    # forbidden forms count whether or not the source holds the term, and anywhere in the target
    forms = locked.select("id", F.explode("forbidden").alias("form"))
    used = term_matches_in(full, forms, text_col="target", term_col="form", how="exact", keep=list(KEYS))
    return each.unionByName(of_terms).unionByName(used.select(*KEYS, lit("forbidden_used").alias("type"), lit("actionable").alias("severity"), F.concat_ws(":", "id", "form").alias("reason")))


def density(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per arm: findings of each severity, and blocking ones per thousand characters of source."""
    chars = pairs.groupBy("arm").agg(F.sum(F.length("source")).alias("chars"), F.count("*").alias("n_pairs"))
    by = lambda s: F.sum((F.col("severity") == s).cast("long"))
    n = found.groupBy("arm").agg(*[by(s).alias(s) for s in ("blocking", "actionable", "informational")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    per = F.round(zero("blocking") * 1000.0 / F.greatest("chars", F.lit(1)), 4)
    return chars.join(n, "arm", "left").select("arm", "n_pairs", *[zero(c).alias(c) for c in ("blocking", "actionable", "informational")], per.alias("blocking_per_1k"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("arm", "severity", "type").agg(F.count("*").alias("n"))


def deltas(per_arm: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Numeric metrics of two arms side by side, as rows, with their difference; the right arm's metrics rule."""
    metrics = [c for c, kind in per_arm.dtypes if c != "arm" and kind in ("bigint", "int", "double")]
    long = per_arm.select("arm", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("m")).select("arm", "m.metric", "m.value")
    left = long.filter(F.col("arm") == a).select("metric", F.col("value").alias("left_value"))
    right = long.filter(F.col("arm") == b).select("metric", F.col("value").alias("right_value"))
    return right.join(left, "metric", "left").select("metric", "left_value", "right_value", F.round(F.col("right_value") - F.col("left_value"), 4).alias("delta"))


def adoption_pivot(adopted: DataFrame, terms: DataFrame, arms: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """A row for each term that any arm met, with what the glossary says of it, and each arm's occurrences, adopted ones and rate: 0, 0 and null without any.

    adopted(arm, id, occurrences, adopted, rate), terms(id, source, preferred, behavior, pos). Of rows of one term the last in the glossary counts, and the first describes it."""
    own = adopted.join(terms.select("id", F.col("source").alias("term"), "preferred", "behavior", "pos"), "id")
    first = own.groupBy("term").agg(F.min_by("preferred", "pos").alias("preferred"), F.min_by("behavior", "pos").alias("behavior"))
    last = lambda c: F.max_by(c, "pos")
    wide = own.groupBy("term").pivot("arm", list(arms)).agg(last("occurrences").alias("occurrences"), last("adopted").alias("adopted"), last("rate").alias("rate"))
    counts = [f"{a}_{c}" for a in arms for c in ("occurrences", "adopted")]
    return first.join(wide.na.fill(0, counts), "term")


def delta_table(per_arm: DataFrame, pairs: tuple[tuple[str, str], ...] = (("A", "B"), ("A", "C"), ("B", "D"), ("A", "D"))) -> DataFrame:
    """``deltas`` of every pair of arms that is compared, as rows."""
    out = None
    for a, b in pairs:
        one = deltas(per_arm, a, b).select(F.lit(f"{a}_to_{b}").alias("comparison"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def repair_rate(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per arm, of the pairs that no memory gave, the share whose first version was mended; null without such pairs. pairs(arm, from_tm, initial_target, target)."""
    own = pairs.filter("NOT from_tm")
    mended = F.count_if(F.coalesce(F.col("initial_target") != F.col("target"), F.lit(False)))
    return pairs.select("arm").distinct().join(own.groupBy("arm").agg(F.round(mended / F.count("*"), 4).alias("automatic_repair_rate")), "arm", "left")


def adoption_notes(adopted: DataFrame, *, low: float = 0.9) -> DataFrame:
    """What an audit says of each term: adoption below ``low``, below 1, or nothing."""
    return adopted.withColumn("note", F.when(F.col("rate") < low, "low adoption").when(F.col("rate") < 1, "not always adopted").otherwise(""))
