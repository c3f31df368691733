"""Evidence for reviewers: what a model asks for, read row by row by a table function, and answered by joins.

Payloads are a model's answers (job, round, payload, blind). A payload's requests come out of it laterally, the first ``MOST`` of them; each distinct one is answered once and
has an id. A blind reviewer sees candidates and accepted targets, and neither formal or first targets nor findings. An answer beyond ``MAX_BYTES`` is withheld, and says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossweave.functions.python import _tolerant
from glossweave.functions.text import term_matches
from glossweave.operators.chain import Deal, as_they_are
from glossweave.operators.numbering import kept
from glossweave.shipping import ship

#: What may be asked for, how much at once, and how large an answer may be.
TOOLS = ("get_segment", "get_neighbors", "find_occurrences", "get_term", "get_document_profile", "get_document_synopsis", "get_section_digest", "get_translation_history", "get_findings")
MOST, MAX_BYTES, NEAR = 5, 24_000, 5

_ASKED = T.StructType(
    [
        T.StructField("pos", T.IntegerType()), T.StructField("tool", T.StringType()), T.StructField("arguments", T.StringType()), T.StructField("segment_id", T.LongType()), T.StructField("any_segment", T.BooleanType()), T.StructField("before", T.IntegerType()),
        T.StructField("after", T.IntegerType()), T.StructField("expression", T.StringType()), T.StructField("selectors", T.ArrayType(T.StringType())), T.StructField("term_id", T.StringType()), T.StructField("term_source", T.StringType()), T.StructField("section_id", T.StringType()),
        T.StructField("problem", T.StringType()),
    ]
)


def _int(x, otherwise: int | None = None) -> int | None:
    try:
        return otherwise if x is None else int(x)
    except (TypeError, ValueError):
        return None


def _str(x) -> str | None:
    return None if x is None or x == "" else str(x)


class _Requests:
    """One row for each request of a payload; one with a problem, if the payload isn't an object with a list of them."""

    def eval(self, payload: str) -> Iterator[tuple]:
        value = _tolerant(payload)
        asked = value.get("evidence_requests", value.get("requests", [])) if isinstance(value, dict) else None
        if not isinstance(asked, list) or any(not isinstance(x, dict) for x in asked):
            yield (0, *[None] * 11, "payload" if not isinstance(value, dict) else "requests")
            return
        for pos, x in enumerate(asked[:MOST], 1):
            tool, own = str(x.get("tool") or x.get("type") or ""), x.get("arguments") or x.get("args") or {}
            own = own if isinstance(own, dict) else {}
            near = [_int(own.get(k, 3)) for k in ("before", "after")]
            near = [None if None in near else max(0, min(NEAR, n)) for n in near]
            chosen = own.get("selectors") or ("first", "middle", "last")
            yield (
                pos, tool, json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":")), _int(own.get("segment_id")), own.get("segment_id") is None, *near, _str(own.get("source_expression") or own.get("source")), [str(s) for s in chosen], _str(own.get("term_id")), _str(own.get("source")),
                _str(own.get("section_id")), None if tool in TOOLS else "tool",
            )


def asked(payloads: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """payloads(job, round, payload, blind) with their requests, by a table function and a lateral join. ``n`` numbers distinct requests in the order in which a job first makes them, ``deduped`` marks repeats.
    They are kept: answers read them ten times, and each would parse the payloads anew."""
    spark = payloads.sparkSession
    ship(spark)
    spark.udtf.register("evidence_requests_of", F.udtf(_Requests, returnType=_ASKED))
    each = spark.sql("SELECT p.job, p.round, p.blind, r.* FROM {p} AS p, LATERAL evidence_requests_of(p.payload) AS r", p=payloads)
    at = F.struct("round", "pos")
    # one shuffle: rows that lie by job serve both windows
    met = deal(each, "job").withColumn("first", F.min(at).over(Window.partitionBy("job", "tool", "arguments"))).withColumn("n", F.dense_rank().over(Window.partitionBy("job").orderBy("first")))
    return kept(met.withColumn("deduped", F.col("first") != at).drop("first"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _segment(history: bool = False) -> Column:
    """A segment as a reviewer may see it."""
    target = F.when(_text("candidate") != "", _text("candidate")).otherwise(_text("accepted_target"))
    blind = F.struct(F.col("seg_idx").alias("segment_id"), F.col("text").alias("source"), target.alias("target"))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("reviewed", "from_tm")]
    targets = [_text("initial_target").alias("initial_target"), _text("target").alias("target")]
    whole = F.struct(F.col("seg_idx").alias("segment_id"), F.col("text").alias("source"), *(targets if history else targets[::-1]), _text("accepted_target").alias("accepted_target"), _text("target_provenance").alias("target_provenance"), *marks)
    return F.when(F.col("blind"), F.to_json(blind)).otherwise(F.to_json(whole))


def answered(requests: DataFrame, segments: DataFrame, glossary: DataFrame, profiles: DataFrame, digests: DataFrame, findings: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """``asked`` requests, each distinct one once, with ``evidence_id`` and ``result`` as JSON.

    segments(job, seg_idx, text, target, initial_target, accepted_target, candidate, target_provenance, reviewed, from_tm); glossary(id, source, entry, pos), profiles(job, profile, synopsis), digests(job, unit_id, start_segment, end_segment, digest, pos) and
    findings(job, seg_idx, finding, pos), with what is returned as JSON. What isn't there is an empty object or an empty list."""
    c = F.col
    key = ["job", "n"]
    once = requests.filter("NOT deduped").drop("deduped", "round", "pos")
    ok = once.filter("problem IS NULL")
    sizes = segments.groupBy("job").agg((F.max("seg_idx") + 1).alias("size"))
    placed = deal(ok, "job").join(sizes, "job")
    there = c("segment_id").between(0, c("size") - 1)
    single = placed.filter(c("tool").isin("get_segment", "get_translation_history") & there).select(*key, "tool", "blind", c("segment_id").cast("int").alias("seg_idx"))
    lo, hi = F.greatest(c("segment_id") - c("before"), F.lit(0)), F.least(c("segment_id") + c("after"), c("size") - 1)
    near = placed.filter((c("tool") == "get_neighbors") & there & c("before").isNotNull()).select(*key, "tool", "blind", F.explode(F.filter(F.sequence(lo, hi), lambda x: x != c("segment_id"))).alias("seg_idx")).withColumn("seg_idx", c("seg_idx").cast("int"))
    held = deal(ok.filter((c("tool") == "find_occurrences") & c("expression").isNotNull()), "job").join(segments.select("job", "seg_idx", "text"), "job").filter(term_matches(c("expression"), c("text")))
    held = held.groupBy(*key, "tool", "blind", "selectors").agg(F.array_sort(F.collect_list("seg_idx")).alias("at"))
    n = F.size("at")
    chosen = F.array_compact(F.array(*[F.when(F.array_contains("selectors", name), F.get("at", at)) for name, at in (("first", F.lit(0)), ("middle", F.floor(n / 2).cast("int")), ("last", n - 1))]))
    found = held.select(*key, "tool", "blind", F.explode(F.array_distinct(chosen)).alias("seg_idx"))
    texts = deal(single.unionByName(near).unionByName(found), "job", "seg_idx").join(segments, ["job", "seg_idx"])
    texts = texts.select(*key, "tool", "seg_idx", F.when(c("tool") == "get_translation_history", _segment(True)).otherwise(_segment()).alias("part"))
    parts = deal(texts, *key).groupBy(*key, "tool").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "part"))), lambda x: x["part"]), ",").alias("parts"))
    of_texts = parts.select(*key, F.when(c("tool").isin("get_neighbors", "find_occurrences"), F.concat(F.lit("["), "parts", F.lit("]"))).otherwise(c("parts")).alias("result"))

    terms = ok.filter("tool = 'get_term'")
    by_id = terms.join(glossary, c("term_id") == c("id")).select(*key, "entry", glossary["pos"])
    by_source = terms.join(glossary.withColumnRenamed("source", "__source"), F.lower("term_source") == F.lower("__source")).select(*key, "entry", glossary["pos"])
    of_terms = by_id.unionByName(by_source).groupBy(*key).agg(F.min_by("entry", "pos").alias("result"))
    of_documents = deal(ok.filter(c("tool").isin("get_document_profile", "get_document_synopsis")), "job").join(profiles, "job").select(*key, F.when(c("tool") == "get_document_profile", c("profile")).otherwise(c("synopsis")).alias("result"))
    fits = (c("section_id") == c("unit_id")) | c("segment_id").between(c("start_segment"), c("end_segment"))
    of_sections = deal(ok.filter("tool = 'get_section_digest'"), "job").join(digests, "job").filter(fits).groupBy(*key).agg(F.min_by("digest", digests["pos"]).alias("result"))
    told = deal(ok.filter("tool = 'get_findings' AND NOT blind"), "job").join(findings, "job").filter(c("any_segment") | (c("segment_id") == c("seg_idx")))
    of_findings = told.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(findings["pos"], "finding"))), lambda x: x["finding"]), ","), F.lit("]")).alias("result"))

    results = of_texts.unionByName(of_terms).unionByName(of_documents).unionByName(of_sections).unionByName(of_findings)
    empty = F.when(c("problem").isNotNull(), F.concat(F.lit('{"error":"'), F.when(c("problem") == "tool", F.concat(F.lit("unknown tool "), "tool")).otherwise(F.concat(F.lit("malformed "), "problem")), F.lit('"}'))).when(c("tool").isin("get_neighbors", "find_occurrences", "get_findings"), "[]").otherwise("{}")
    size = F.octet_length("result")
    withheld = F.concat(F.lit('{"error":"evidence is too large","payload_bytes":'), size.cast("string"), F.lit(f',"max_bytes":{MAX_BYTES}}}'))
    own = deal(once, *key).join(results, key, "left").withColumn("result", F.coalesce("result", empty))
    return own.select("job", F.concat(F.lit("E"), "n").alias("evidence_id"), "n", "tool", "arguments", "blind", F.when(size > MAX_BYTES, withheld).otherwise(c("result")).alias("result"))


def trace(requests: DataFrame, answers: DataFrame, *, deal: Deal = as_they_are) -> DataFrame:
    """Every request in its round, repeats too, with the evidence that it got, and whether its job's review has failed: on a malformed payload, or by asking in a later round than the first."""
    c = F.col
    bad = deal(requests, "job").groupBy("job").agg(F.bool_or(c("problem").isin("payload", "requests") | ((c("round") > 0) & c("tool").isNotNull())).alias("failed"))
    met = deal(deal(requests, "job", "n").join(answers.select("job", "n", "evidence_id", "result"), ["job", "n"]), "job").join(bad, "job")
    return met.select("job", "round", "pos", "evidence_id", "tool", "deduped", "result", F.coalesce("failed", F.lit(False)).alias("failed"))
