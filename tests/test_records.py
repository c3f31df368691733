"""Rules over records against fixtures and plain Python."""

import difflib
import unicodedata

from pyspark.sql import functions as F

from glossweave.functions.python import delta, find_span, meaningful_revision, tail_similarity
from glossweave.operators import cases, delivery, diagnostics, human, literature, records


def _plain(x, punctuation=True):
    return "".join(c for c in unicodedata.normalize("NFKC", x or "").casefold() if not c.isspace() and (punctuation or unicodedata.category(c)[0] not in "PZ"))


def test_revisions_deltas_and_spans(spark):
    rows = [("a b c", "a B  c"), ("a b", "a, b."), ("one two", "one three"), (None, "x"), ("", "x"), ("x", ""), ("ﬁne", "fine"), ("straße", "STRASSE!"), ("a b c d", "b c x d")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", meaningful_revision("a", "b").alias("m"), delta("a", "b").alias("d")).collect()
    for r in got:
        x, y = _plain(r["a"]), _plain(r["b"])
        assert r["m"] == (bool(x and y and x != y) and _plain(r["a"], False) != _plain(r["b"], False))
        old, new = (r["a"] or "").split(), (r["b"] or "").split()
        codes = [c for c in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if c[0] != "equal"]
        assert [(d["op"], d["old"], d["new"]) for d in r["d"]] == [(op, " ".join(old[i:j]), " ".join(new[k:m])) for op, i, j, k, m in codes]
    text = "The “quick” brown–fox jumps.  And runs… then stops."
    spans = spark.createDataFrame([(n, text) for n in ("“quick”", '"quick"', "brown-fox jumps. And", "runs... then", "no", "")], "n string, t string")
    found = {r["n"]: r["s"] and (r["s"]["start"], r["s"]["end"]) for r in spans.select("n", find_span("n", "t").alias("s")).collect()}
    assert text[slice(*found['"quick"'])] == text[slice(*found["“quick”"])] == "“quick”"
    assert text[slice(*found["brown-fox jumps. And"])] == "brown–fox jumps.  And"
    assert text[slice(*found["runs... then"])] == "runs… then"
    assert found["no"] == found[""] == (None, None)


def test_targets_that_run_on_into_the_next(spark):
    base = "a target text that goes on for more than sixty characters, word by word and line by line"
    rows = [(1, 0, "s", base + " more", "x"), (1, 1, "s", base, None), (1, 2, "s", "z" * 70, "something else entirely, in its own words"), (1, 3, "s", "z", None)]
    df = spark.createDataFrame(rows, "conv_id long, seg_idx long, source string, target string, initial_target string")
    flags = {r["seg_idx"]: r["flags"] for r in cases.integrity_flags(df).collect()}
    assert flags == {0: ["probable_adjacent_target_overlap"], 1: [], 2: [], 3: []}
    sim = df.filter("seg_idx = 0").select(tail_similarity("target", F.lit(base)).alias("s")).first()["s"]
    x, y = _plain(base + " more"), _plain(base)
    assert abs(sim - difflib.SequenceMatcher(None, x[-len(y) :], y, autojunk=False).ratio()) < 1e-9


def test_trusted_pairs_and_risks(spark):
    """An accepted risk is delivered but never remembered."""
    pairs = spark.createDataFrame([(1, k, True, k == 4) for k in range(5)], "conv_id long, seg_idx long, reviewed boolean, stale boolean")
    found = [(1, 0, "blocking", True, "accepted_risk"), (1, 1, "actionable", True, "retranslated"), (1, 2, "informational", False, None), (1, 3, "actionable", False, None)]
    findings = spark.createDataFrame(found, "conv_id long, seg_idx long, severity string, resolved boolean, action string")
    assert {r["seg_idx"] for r in delivery.trusted(pairs, findings).collect()} == {1, 2}


def test_roles_questions_and_needs(spark):
    texts = ["", "x <!--claim:c1-->", "see seg-a-0001 for it", "综上所述，笔者认为好", "本节小结如下", "首先是这样的", "skopos: this suggests more than that, and then some more", "the translation renders the sentence in another way altogether", "this indicates that the words were chosen with care and thought", "short", "background " * 6]
    want = ["filler", "claim", "evidence", "generic", "summary", "transition", "theoretical_interpretation", "translation_description", "analysis", "filler", "background"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    assert [r["r"] for r in df.orderBy("n").select(diagnostics.role(F.col("t")).alias("r")).collect()] == want
    answers = spark.createDataFrame([("don't remember",), ("not sure。",), (" ",), ("because it reads better",)], "a string")
    assert [r[0] for r in answers.select(human.answer_status(F.col("a"))).collect()] == ["unavailable_after_human_check"] * 2 + ["needs_clarification", "user_confirmed"]


def test_literature_and_records_on_empty_tables(spark):
    none = spark.createDataFrame([], "source_id string, kind string, text string, pos long")
    assert literature.evidence(none, literature.blocks(none)).count() == 0
    one = spark.createDataFrame([("s", "content", " \n\n ", 0)], none.schema)
    assert [(r["provenance"], r["eligible"]) for r in literature.evidence(one, literature.blocks(one)).collect()] == [("metadata_only", False)]
    names = spark.createDataFrame([(0, "A b"), (1, "a B"), (2, "!"), (3, None)], "pos int, name string")
    assert [r["unique_id"] for r in literature.unique_ids(names, "name", "pos").orderBy("pos").collect()] == ["a-b", "a-b-2", "reference", "reference-2"]
    lines = spark.createDataFrame([(1, "{"), (2, "[]"), (3, None)], "n int, line string")
    assert {tuple(r) for r in records.line_violations(lines, "n").collect()} == {(1, "invalid_json"), (2, "invalid_json"), (3, "invalid_json")}


def test_revision_deltas_and_tolerant_spans_on_the_tables(spark, sf_dir):
    """The two registered queries without SQL, against plain Python over the same tables."""
    import difflib
    import re

    import __spark_entry__  # noqa: F401  it loads all that add to the catalogue
    from glossweave.functions.python import revised
    from glossweave.plans.catalogue import QUERIES, _pairs, _segments

    got = {(r["conv_id"], r["seg_idx"]): (r["n_changes"], r["revised"], r["similarity"]) for r in QUERIES["revision_deltas"](spark, sf_dir).collect()}
    for r in _pairs(spark, sf_dir).collect():
        codes = difflib.SequenceMatcher(None, r["source"].split(), r["target"].split(), autojunk=False).get_opcodes()
        n = sum(op != "equal" for op, *_ in codes)
        near = difflib.SequenceMatcher(None, r["source"], r["target"], autojunk=False).ratio()
        k = got.pop((r["conv_id"], r["seg_idx"]))
        assert k[:2] == (n, revised(r["source"], r["target"])) and abs(k[2] - near) < 1e-4
    assert not got
    spans = {(r["doc_id"], r["seg_idx"]): (r["start"], r["end"]) for r in QUERIES["tolerant_spans"](spark, sf_dir).collect()}
    for r in _segments(spark, sf_dir).collect():
        needle = r["text"][2:17].replace(" ", "  ")
        pattern = r"\s+".join(map(re.escape, needle.split()))
        plain = r["text"].translate(str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-"}))
        at = r["text"].find(needle) if needle.strip() else -1
        found = (at, at + len(needle)) if at >= 0 else (m.span() if needle.strip() and (m := re.search(pattern, plain)) else (None, None))
        assert spans.pop((r["doc_id"], r["seg_idx"])) == found
    assert not spans
