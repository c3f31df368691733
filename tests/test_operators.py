"""Operators on small literal inputs."""

import json

from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import evidence, matching, memory, qa, sequence
from glossweave.sources import files
from glossweave.sources.derived import GLOSSARY_SCHEMA
from glossweave.streaming import event_log

PAIR = "arm string, conv_id long, seg_idx int, source string, target string"


def test_term_matches(spark):
    rows = [
        ("Skopos", "The Skopos theory is central.", True), ("skopos", "The SKOPOS theory is central.", True), ("MT", "MT is machine translation.", True), ("MT", "The MTI tool translates books.", False),
        ("AI", "The mountain is high in the main range.", False), ("AI", "The AI model works.", True), ("目的论", "翻译目的论是核心概念。", True), ("", "text", False), ("x", None, False), ("école", "xécole", False), ("a.b", "(A.B)", True),
    ]
    df = spark.createDataFrame(rows, "term string, text string, want boolean")
    assert not df.filter(text.term_matches(F.col("term"), F.col("text")) != F.col("want")).collect()
    # the automaton finds the same pairs as the plain test
    texts = df.filter("text IS NOT NULL").select("text").distinct()
    names = df.filter("term <> ''").select(F.col("term").alias("source")).distinct()
    got = {(r["source"], r["text"]) for r in matching.term_matches_in(texts, names).distinct().collect()}
    plain = texts.crossJoin(names).filter(text.term_matches(F.col("source"), F.col("text")))
    assert got == {(r["source"], r["text"]) for r in plain.collect()}


def test_incomplete(spark):
    long = "This is a sentence of forty-five characters. " * 6
    rows = [(long, "一句话。", True), (long, "译" * 100, False), ("短句", "", True), ("One. Two.", "一", False), ("One. Two. Three. Four. Five.", "一。", True), ("One. Two.", "One and two.", False), ("At 5 p.m. Dr. No left.", "Weg.", False)]
    df = spark.createDataFrame(rows, "s string, t string, want boolean")
    assert not df.filter(text.incomplete(F.col("s"), F.col("t")) != F.col("want")).collect()


def test_pack(spark):
    def batches(lengths):
        df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "doc_id long, seg_idx int, text string")
        out = {}
        for r in sequence.pack(df).collect():
            out.setdefault(r["batch"], []).append(lengths[r["seg_idx"]])
        return [out[k] for k in sorted(out)]

    assert batches([1] * 6) == [[1] * 4, [1] * 2]
    assert batches([900, 900, 1]) == [[900], [900, 1]]
    assert batches([900, 1700, 1]) == [[900], [1700], [1]]


def test_overlay(spark):
    spans = [("k", 0, 20, "hard", 2), ("k", 4, 10, "rare", 0), ("k", 10, 14, "domain", 1)]
    got = sequence.overlay(spark.createDataFrame(spans, "key string, a int, b int, kind string, priority int")).orderBy("x").collect()
    assert [(r["x"], r["y"], r["kind"]) for r in got] == [(0, 4, "hard"), (4, 10, "rare"), (10, 14, "domain"), (14, 20, "hard")]


def test_overlay_of_many_keys(spark):
    """Against a plain loop, in batches that cut keys; no span is joined with the pieces of its key."""
    import random

    draw = random.Random(6)
    spans = [(draw.randint(0, 40), a, a + draw.randint(0, 9), draw.choice("xyz"), k) for k, a in enumerate(draw.randint(-3, 30) for _ in range(700))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        found = sequence.overlay(spark.createDataFrame(spans, "key int, a int, b int, kind string, priority int"))
        got = {(r["key"], r["x"], r["y"]): r["kind"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for key in {s[0] for s in spans}:
        own = [s for s in spans if s[0] == key]
        bounds = sorted({x for s in own for x in s[1:3]})
        for x, y in zip(bounds, bounds[1:], strict=False):
            over = [s for s in own if s[1] <= x and s[2] >= y]
            if over:
                want[key, x, y] = min(over, key=lambda s: s[4])[3]
    assert got == want and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_findings(spark):
    glossary = [("g1", "John Smith", "", [], "preserve", "locked", "", 0), ("g2", "theory", "Theorie", ["Lehre"], "translate", "locked", "", 1)]
    g = spark.createDataFrame(glossary, GLOSSARY_SCHEMA).withColumnRenamed("source", "term_source")
    rows = [
        ("A", 1, 0, "Use %s at https://x.org by John Smith, a theory [12].", "Die Lehre."), ("A", 1, 1, "Words here", "  "), ("A", 1, 2, "Two words", "two  WORDS"),
        ("A", 1, 3, "some remaining source", "noch remaining source da"),
    ]
    got = {(r["seg_idx"], r["type"], r["severity"], r["reason"]) for r in qa.findings(spark.createDataFrame(rows, PAIR), g).collect()}
    assert {
        (0, "token_lost", "blocking", "%s"), (0, "token_lost", "actionable", "https://x.org"), (0, "token_lost", "actionable", "[12]"), (0, "preserve_lost", "actionable", "g1"), (0, "term_missing", "actionable", "g2"),
        (0, "forbidden_used", "actionable", "g2:Lehre"), (1, "blank", "blocking", ""), (2, "identical", "actionable", ""), (3, "residual", "actionable", "remaining source"),
    } <= got
    assert not [x for x in got if x[0] == 1 and x[1] != "blank"]


def test_insert_if_absent(spark):
    have = spark.createDataFrame([("a1", "x")], "source string, target string")
    rows = spark.createDataFrame([("a1", "y", 0), ("b2", "z", 1), ("b2", "w", 0), ("??", "v", 0), ("c3", " ", 0)], "source string, target string, pos int")
    assert {tuple(r) for r in memory.insert_if_absent(have, rows).collect()} == {("a1", "x"), ("b2", "w")}


def test_violations_of_a_clean_graph(spark):
    text_ = "A line of  evidence"
    import hashlib

    claims = spark.createDataFrame([("c1", "s1", ["e1"])], "claim_id string, source_id string, evidence_ids array<string>")
    found = spark.createDataFrame([("e1", "s1", "b1", text_, hashlib.sha256(text_.encode()).hexdigest(), True)], "evidence_id string, source_id string, block_id string, text string, content_hash string, eligible boolean")
    sources = spark.createDataFrame([("s1", True)], "source_id string, citable boolean")
    blocks = spark.createDataFrame([("b1", "s1", "Here: A line of evidence.")], "block_id string, source_id string, text string")
    assert evidence.status(evidence.claim_violations(claims, found, sources, blocks)).first()["status"] == "pass"
    bad = claims.unionByName(spark.createDataFrame([("c2", "s9", [])], claims.schema))
    assert {r["type"] for r in evidence.claim_violations(bad, found, sources, blocks).collect()} == {"claim_without_evidence", "claim_source_missing"}


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Source,Target,Forbidden,Status\nSkopos,目的论,功能；对等,locked\n,leer,,\n", encoding="utf-8")
    row = files.read_termbase(spark, str(tmp_path / "t.csv")).collect()
    assert [(r["source"], r["target"], r["forbidden"], r["status"]) for r in row] == [("Skopos", "目的论", ["功能", "对等"], "locked")]
    pairs = spark.createDataFrame([("hello", "hallo"), ("??", "weg")], "source string, target string")
    files.write_tmx(pairs, str(tmp_path / "m.tmx"))
    assert [tuple(r) for r in files.read_tmx(spark, str(tmp_path / "m.tmx")).collect()] == [("hello", "hallo")]
    files.write_tbx(pairs, str(tmp_path / "m.tbx"))
    assert {(r["source"], r["target"]) for r in files.read_tbx(spark, str(tmp_path / "m.tbx")).collect()} == {("hello", "hallo"), ("??", "weg")}
    (tmp_path / "a.bib").write_text("@article{key1,\n  title = {A title},\n  author = {Doe, J.},\n  year = {2001},\n}\n")
    assert [tuple(r) for r in files.read_bibtex(spark, str(tmp_path / "a.bib")).collect()] == [("key1", "A title", "Doe, J.", "2001")]
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - Name\nAU  - Doe, J.\nAU  - Roe, R.\nPY  - 1999/01\nER  - \n")
    (tmp_path / "b.ris").write_text("TY  - BOOK\nT1  - A long\n  title\nA1  - Lee, A.\nDO  - 10.1/x\nER  - \nTY  - JOUR\nER  - \n")
    got = {tuple(r) for r in files.read_ris(spark, str(tmp_path / "*.ris")).selectExpr("title", "array_join(authors, '|')", "year", "doi").collect()}
    assert got == {("Name", "Doe, J.|Roe, R.", "1999", ""), ("A long title", "Lee, A.", "", "10.1/x")}
    entry = "<termEntry><langSet xml:lang='en'><tig><term>a</term></tig></langSet><langSet xml:lang='en'><tig><term>b</term></tig></langSet>{}</termEntry>"
    other = "<langSet xml:lang='zh'><ntig><termGrp><term>c</term></termGrp></ntig></langSet>"
    (tmp_path / "n.tbx").write_text(f"<body>{entry.format(other)}{entry.format('')}</body>")
    assert [tuple(r) for r in files.read_tbx(spark, str(tmp_path / "n.tbx")).collect()] == [("a", "c", "locked")]
    (tmp_path / "s.json").write_text('{"job": "x", "n": 3}\n[1]\n{"job": "y"\n')
    assert [tuple(r) for r in files.read_states(spark, str(tmp_path / "s.json"), "job string, n int").collect()] == [("x", 3)]
    files.write_artifact(pairs, str(tmp_path / "art"), {"version": "1"})
    assert files.read_artifact(spark, str(tmp_path / "art"), "source string, target string").count() == 2


def test_event_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    pending = {"batch": 1, "offset": 1, "phase": "tm_promotion_pending", "segment_count": 1, "entries": [{"source": "a", "target": "b"}, {"source": "a", "target": "b"}, {"source": "c", "target": " "}]}
    early = {"batch": 3, "offset": 0, "phase": "tm_promotion_pending", "entries": [{"source": "too", "target": "early"}]}
    (log / "1.json").write_text("\n".join([json.dumps({"batch": 1, "offset": 0, "phase": "state_commit_done"}), json.dumps(pending), "broken {", json.dumps({"batch": 2, "offset": 2, "phase": "generation_done"}), json.dumps(early)]) + "\n")
    for _ in range(2):  # the second run finds nothing new
        event_log.promote(spark, str(log), str(tmp_path / "memory"), str(tmp_path / "checkpoint"))
    assert [(r["source"], r["target"]) for r in spark.read.json(str(tmp_path / "memory")).collect()] == [("a", "b")]
    read = event_log.read_log(spark, str(log))
    assert {(r["batch"], r["phase"]) for r in event_log.last_phase(read).collect()} == {(1, "tm_promotion_pending"), (2, "generation_done"), (3, "tm_promotion_pending")}
    assert {r["batch"] for r in event_log.unpromoted(read).collect()} == {1, 3}
    # a later batch doesn't bring a source again
    event_log.append(spark.createDataFrame([(4, 9, "state_commit_done", None, None), (4, 10, "tm_promotion_pending", 1, [("a", "z"), ("d", "e")])], event_log.SCHEMA), str(log))
    event_log.promote(spark, str(log), str(tmp_path / "memory"), str(tmp_path / "checkpoint"))
    assert {(r["source"], r["target"]) for r in event_log.read_memory(spark, str(tmp_path / "memory")).collect()} == {("a", "b"), ("d", "e")}


def test_every_token_is_counted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [f"rare{letters[k // 26 // 26 % 26]}{letters[k // 26 % 26]}{letters[k % 26]}" for k in range(1500)]
    docs = spark.createDataFrame([(1, " ".join(["Common"] * 9 + rare)), (2, "common " + " ".join(rare[:5])), (3, None)], "doc_id long, text string")
    want = {**{w: 2 if k < 5 else 1 for k, w in enumerate(rare)}, "common": 10}
    assert {r["token"]: r["n"] for r in sequence.token_counts(docs).collect()} == want
    assert {r["token"]: r["n"] for r in sequence.rare_tokens(docs).collect()} == {w: n for w, n in want.items() if n < 8}


def test_caps_within_segments_without_a_shuffle(spark):
    rows = [(1, 0, [("rare", "a"), ("hard", "b"), ("rare", "a"), ("rare", "c"), ("odd", "z"), ("hard", "d"), ("hard", "e"), ("rare", "f"), ("rare", "g")]), (1, 1, []), (2, 0, None)]
    listed = spark.createDataFrame(rows, "doc_id long, seg_idx int, annotations array<struct<type string, span string>>")
    found = sequence.caps_within(listed, {"rare": 3, "hard": 2})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    each = listed.select("doc_id", "seg_idx", F.posexplode("annotations").alias("pos", "x")).select("doc_id", "seg_idx", "pos", "x.*")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sequence.caps(each, {"rare": 3, "hard": 2}).collect()))
    assert {r["span"] for r in found.collect()} == {"a", "c", "f", "b", "d"}


def test_chain_is_dealt_by_the_keys_of_its_joins(spark):
    from glossweave.operators import chain

    texts = "array<string>"
    sections = spark.createDataFrame([(1, "s0", 0, ["C1"], ["K1"]), (1, "s1", 1, [], [])], f"doc_id long, section_id string, pos int, claims {texts}, cases {texts}")
    claims = spark.createDataFrame([(1, "C1", ["K2"], ["L1"], ["E1"]), (1, "C2", [], ["L2"], ["E1"])], f"doc_id long, claim_id string, cases {texts}, literature_claims {texts}, literature_evidence {texts}")
    questions = spark.createDataFrame([(1, "q0")], "doc_id long, rq string")
    cases = spark.createDataFrame([(1, "K1", False), (1, "K2", False), (1, "K3", True)], "doc_id long, case_id string, synthetic boolean")
    evidence = spark.createDataFrame([("E1", "S1")], "evidence_id string, source_id string")
    met = []

    def deal(df, *keys):
        met.append(keys)
        return df.repartition(3, *keys)

    plain, dealt = chain.closed_outline(sections, claims, questions, cases, evidence), chain.closed_outline(sections, claims, questions, cases, evidence, deal=deal)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))
    assert {("doc_id", "ref"), ("doc_id", "case_id"), ("doc_id", "claim"), ("ref",)} <= set(met)


def _report(k):
    return f"paragraph that recurs {k % 2}\n\nclosing words of skopos theory {k}. <!--claim:c{k % 2}--> <!--rq:q{k % 3}--> seg-j-000{k % 2}\n\nA sentence without any marker {k}."


def test_diagnostics_are_dealt_by_the_keys_of_their_joins(spark):
    from glossweave.operators import diagnostics

    sections = spark.createDataFrame([(d, k, _report(k), k == d + 2) for d in (1, 2) for k in range(d + 3)], "doc_id long, seg_idx int, body string, last boolean")
    plan = spark.createDataFrame([(d, k, kind, ref) for d in (1, 2) for k in range(3) for kind, ref in (("claim", "c1"), ("rq", f"q{k}"), ("case", f"seg-j-000{k}")) if k != d or kind != "rq"], "doc_id long, seg_idx int, kind string, ref string")
    claims = spark.createDataFrame([(d, f"c{k}") for d in (1, 2) for k in range(3)], "doc_id long, claim_id string")
    questions = spark.createDataFrame([(d, f"q{k}") for d in (1, 2) for k in range(3)], "doc_id long, rq string")
    known = spark.createDataFrame([("c1", "q0"), ("c2", "q1")], "claim_id string, rq string")
    worth = plan.filter("kind = 'case'").selectExpr("doc_id", "ref", "doc_id = 1 AS severe", "false AS changed", "false AS repair", "false AS terms").distinct()
    cases = spark.createDataFrame([(1, "k1", "weak_case", True, True)], "doc_id long, case_id string, class string, synthetic boolean, revision boolean")
    met = []

    def deal(df, *keys):
        met.append(keys)
        return df.repartition(3, *keys)

    def found(last, **how):
        d = diagnostics
        parts = (d.unused_evidence(worth, sections, **how), d.untraced(sections, last=last), d.repeats(sections, **how), d.unsupported(sections))
        return d.diagnosed(d.question_matrix(plan, questions, known, **how), plan, claims, sections, cases, *parts, literature=False, **how)

    plain, dealt = found(None), found(F.col("last"), deal=deal)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
    assert {r["type"] for r in plain.collect()} >= {"orphan_claim", "duplicate_paragraph", "conclusion_without_trace", "theory_name_dropping", "high_value_evidence_unused", "section_without_research_question"}
    assert {("doc_id", "ref"), ("doc_id", "claim_id"), ("doc_id", "rq"), ("doc_id", "seg_idx")} <= set(met)
    # a section known as the last needs no other row
    assert "Exchange" not in diagnostics.untraced(sections, last=F.col("last"))._jdf.queryExecution().executedPlan().toString()
    kind = ["type", "priority", "severity"]
    want = plain.groupBy(*kind).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    assert sorted(map(tuple, diagnostics.counted(dealt, deal=deal).collect())) == sorted(map(tuple, want.collect()))


def test_last_segments_are_known_where_they_are_made(spark):
    from glossweave.sources import derived

    docs = spark.createDataFrame([(1, "one\n\ntwo lines\n***\n"), (2, "  \n"), (3, None), (4, "only")], "doc_id long, text string")
    own = derived.segments(docs, last="last")
    assert sorted(map(tuple, own.collect())) == [(1, 0, "one", False), (1, 1, "two lines", True), (4, 0, "only", True)]
    assert sorted(map(tuple, own.drop("last").collect())) == sorted(map(tuple, derived.segments(docs).collect()))
