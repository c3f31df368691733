"""Rules that look at whole texts, held against plain loops."""

import difflib
import random
import re

import pytest

from glossweave.functions.python import contrast, revised
from glossweave.operators import alignment, diagnostics, gates, literature, records

F = pytest.importorskip("pyspark.sql.functions")


def test_hits_within_one_window(spark):
    body = "采用了直译策略，提高了译文的可读性；运用了增译策略，使译文更加自然。"
    df = spark.createDataFrame([(1, 0, body), (1, 1, "improves readability, semantic. improves fluency"), (1, 2, ""), (2, 0, None)], "doc_id long, seg_idx int, body string")
    got = [(r["seg_idx"], r["type"]) for r in diagnostics.unsupported(df).collect()]
    assert sorted(got) == [(0, "strategy_label_without_mechanism")] * 2 + [(0, "unsupported_quality_effect")] * 2
    first = next(r["hit"] for r in diagnostics.unsupported(df).collect() if r["type"].startswith("strategy"))
    assert first == f"采用了直译策略 {body}"


def test_windows(spark):
    text = "aXbXXc X" + "y" * 30 + "X"
    got = spark.createDataFrame([(text,)], "t string").select(diagnostics.windows(F.col("t"), "X", 2, 3).alias("w")).first()["w"]
    assert [(w["match"], w["window"]) for w in got] == [(m[0], text[max(0, m.start() - 2) : m.end() + 3]) for m in re.finditer("X", text)]


def test_described_revisions(spark):
    bodies = [
        (1, 0, "In [a]: 将“旧译表达”改为“新译表达”，" + "且" * 90 + "将“没有”改为“新译表达”。"), (1, 1, "[b] 经过修订。"), (1, 2, "[c] 从“bad … words”改成“good words”。"), (1, 3, "经过修订，没有案例；将“x”改为“y”。"), (1, 4, "[a] says nothing"), (1, 5, "[a] 从“旧”变成“新”，修订后"),
    ]
    plan = [(1, k, c) for k, c in enumerate("abcaaa")]
    cases = [(1, "a", "旧译表达。", "新译表达。", True), (1, "b", "同", "同", False)]
    made = [(1, "c", "some bad and sad words", "some good words")]
    got = diagnostics.described_revisions(
        spark.createDataFrame(bodies, "doc_id long, seg_idx int, body string"), spark.createDataFrame(plan, "doc_id long, seg_idx int, case_id string"),
        spark.createDataFrame(cases, "doc_id long, case_id string, initial_target string, target string, eligible boolean"), spark.createDataFrame(made, "doc_id long, case_id string, baseline string, optimized string"),
    )
    assert sorted((r["seg_idx"], r["type"], r["ref"]) for r in got.collect()) == [(0, "described_revision_not_in_stored_delta", "没有→新译表达"), (1, "invented_revision", "b")]


def test_contrast(spark):
    rows = [("old text here", "new text there"), ("Same.", "same"), (None, "x"), ("", ""), ("abc" * 60, "abd" * 60)]
    got = spark.createDataFrame(rows, "a string, b string").select(contrast("a", "b").alias("x")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        codes = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes() if revised(a, b) else []
        assert r["x"]["changed"] == revised(a, b)
        assert [tuple(c) for c in r["x"]["changes"]] == [(op, a[i:j][:120], b[k:m][:120]) for op, i, j, k, m in codes if op != "equal"]


def _give(names):
    used, out = set(), []
    for name in names:
        base = re.sub("[^A-Za-z0-9_-]+", "-", name or "").strip("-_").lower() or "reference"
        given, k = base, 2
        while given in used:
            given, k = f"{base}-{k}", k + 1
        used.add(given)
        out.append(given)
    return out


def test_unique_ids(spark):
    draw = random.Random(8)
    names = ["a", "a", "a-2", "a", "a-2-2", "a-2", "", None, "--", "a-02", "A!", "b", "b", "9", "9", "9-2"] + [draw.choice(["a", "b", "a-3", "a-2", "a-2-3", "c", "c d", "c-d-2", "reference-2", ""]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    got = {r["pos"]: r["unique_id"] for r in literature.unique_ids(df, "name", "pos").collect()}
    assert [got[k] for k in range(len(names))] == _give(names) and len(set(got.values())) == len(names)


def test_families_stay_in_one_task(spark):
    """Spark drops a repartition by a merge join's key, and then reads the join's parts otherwise if one side turns out small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(0, 600, 1, 6).selectExpr("id AS pos", "'a' || (id % 40) || '-2' AS name")
        plan = literature.unique_ids(df, "name", "pos")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "REPARTITION_BY_COL" in plan[plan.index("MapInArrow") :]


def test_values_are_not_read_again(spark):
    values = {"{{STAT:k}}": "{{TERM:t}}", "{{TERM:t}}": "v {{STAT:k}} $1 \\", "[@a]": "(A)"}
    bodies = ["{{STAT:k}}{{TERM:t}}", "x [@a] {{STAT:none}} [@a][@b]", "", "no token", None, "{{TERM:t}}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {r["k"]: r["body"] for r in records.expand(df, spark.createDataFrame(list(values.items()), "token string, value string"), "k").collect()}
    assert [got[k] for k in range(6)] == [b and re.sub(r"\{\{(?:STAT|TERM):\w+\}\}|\[@\w+\]", lambda m: values.get(m[0], m[0]), b) for b in bodies]


def test_exact_quotes(spark):
    body = "> [SOURCE s1]: wrong\nkept > [TARGET s1]: in a line\n> [TARGET s1]: \n> [INITIAL s1]: as it was\n>  [SIMULATED  c1]: x\n> [OTHER s1]: y\n> [SOURCE s9]: z"
    cases = [("SOURCE", "s1", "right $0"), ("TARGET", "s1", "> [SOURCE s1]: t"), ("INITIAL", "s1", None), ("SIMULATED", "c1", "sim")]
    got = records.exact_quotes(spark.createDataFrame([(1, body), (2, "none")], "k int, body string"), spark.createDataFrame(cases, "kind string, case_id string, text string"), "k").collect()
    # as in the rule, the space after a colon may end the line, and then what it quotes is the next one
    want = "> [SOURCE s1]: right $0\nkept > [TARGET s1]: in a line\n> [TARGET s1]: > [SOURCE s1]: t\n> [SIMULATED c1]: sim\n> [OTHER s1]: y\n> [SOURCE s9]: z"
    assert {r["k"]: r["body"] for r in got} == {1: want, 2: "none"}


GOOD = {
    "case_id": "c", "segment_id": "s", "source_text": "The old bridge", "trigger": "OLD", "reason": "r", "plausibility": "plausible", "grounding": "confirmed", "materiality_check": "confirmed", "correctness": "confirmed", "value": "confirmed", "already_correct": False, "unrelated_change": False,
    "baseline": "die Brücke", "optimized": "die alte Brücke", "error_id": "E1", "materiality": "major", "diagnosis": "d", "error_span": "old", "repairs": "E1", "decision": "d", "addresses": "a",
}
BAD = {
    "real_source_exists": [{"segment_id": "none"}, {"source_text": "The old bridge fell"}], "opportunity_grounded": [{"reason": ""}, {"trigger": None}, {"trigger": "new"}], "baseline_plausible": [{"plausibility": None}, {"plausibility": "borderline"}], "diagnosis_evidence_backed": [{"error_span": "gone"}, {"grounding": "yes"}],
    "error_confirmed": [{"materiality": "minor"}, {"diagnosis": ""}, {"materiality_check": None}], "repair_confirmed": [{"correctness": "partial"}], "repair_value_confirmed": [{"value": None}], "repair_traceable": [{"repairs": "E2"}, {"decision": None}, {"error_id": "", "repairs": ""}], "meaningful_contrast": [{"optimized": "Die Brücke!"}],
    "baseline_not_already_correct": [{"already_correct": True}, {"already_correct": None}], "no_unrelated_meaning_change": [{"unrelated_change": None}],
}


def test_gates(spark):
    rows = [GOOD] + [{**GOOD, **change} for changes in BAD.values() for change in changes]
    schema = ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'string'}" for c, v in GOOD.items())
    df = spark.createDataFrame([(k, *(r[c] for c in GOOD)) for k, r in enumerate(rows)], f"k int, {schema}")
    got = {r["k"]: r for r in gates.gated(df, spark.createDataFrame([("s", "x The old bridge, y")], "segment_id string, source string")).collect()}
    assert got[0]["eligible"] and got[0]["failed"] == []
    assert [(got[k + 1]["first_failed"], got[k + 1]["eligible"]) for k in range(len(rows) - 1)] == [(gate, False) for gate, changes in BAD.items() for _ in changes]
    german = {**GOOD, "source_text": "die Straße", "trigger": "STRASSE", "error_span": "DIE STRAẞE"}
    df = spark.createDataFrame([tuple(german.values())], schema)
    assert gates.gated(df, spark.createDataFrame([("s", "die Straße")], "segment_id string, source string")).first()["failed"] == []
    both = {**GOOD, "already_correct": None, "plausibility": "x"}
    df = spark.createDataFrame([tuple(both.values())], schema)
    assert gates.gated(df, spark.createDataFrame([("s", "The old bridge")], "segment_id string, source string")).first()["failed"] == ["baseline_plausible", "baseline_not_already_correct"]


def test_alignment(spark):
    """Repeats, lost and moved paragraphs, merged and split ones, empty ones; by the moving cursor in plain Python."""
    draw = random.Random(3)
    words = "alpha beta “gamma” delta’s — mu… pi rho".split()
    old, new = [], []
    for doc in range(30):
        paragraphs = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 4))) for _ in range(draw.randint(0, 12))]
        old += [(doc, k, p, draw.choice(["x y z" * 9, "x" * 40, "  ", None, "译文" * 9])) for k, p in enumerate(paragraphs)]
        changed = [p for p in paragraphs if draw.random() < 0.8]
        if draw.random() < 0.3:
            changed.reverse()
        k = 0
        while changed:
            n = draw.randint(1, 2)
            new.append((doc, k, " ".join(changed[:n]).replace("’", "'").upper() + (" new" if draw.random() < 0.2 else "")))
            changed, k = changed[n:], k + 1
    o, n = spark.createDataFrame(old, "doc_id long, seg_idx int, source string, target string"), spark.createDataFrame(new, "doc_id long, new_idx int, text string")
    placed = alignment.placements(o, n)
    assert "CoGroup" not in placed._jdf.queryExecution().optimizedPlan().toString()  # no Python call for each document

    def norm(s):
        for a, b in zip("’‘“”–—", "''\"\"--", strict=True):
            s = s.replace(a, b)
        return re.sub(r"\s+", "", s.replace("…", "...")).lower()

    want, carried = {}, {}
    for doc in range(30):
        there = sorted((k, norm(t)) for d, k, t in new if d == doc)
        stream = "".join(t for _, t in there)
        owner = [k for k, t in there for _ in t]
        cursor = 0
        for d, k, source, target in old:
            if d != doc:
                continue
            form = norm(source)
            if not form or not (target or "").strip():
                want[d, k] = ("suspect" if form else "empty", None, None)
                continue
            p = stream.find(form, cursor)
            p = stream.find(form) if p < 0 else p
            if p >= 0:
                cursor = p + len(form)
            want[d, k] = ("not_found", None, None) if p < 0 else ("placed", owner[p], owner[cursor - 1])
        for k, form in there:
            inside = [(i, norm(s), t.strip()) for d, i, s, t in old if d == doc and want[d, i][1:] == (k, k)]
            if inside and "".join(f for _, f, _ in inside) == form:
                carried[doc, k] = (len(inside), ("" if "译" in inside[0][2] else " ").join(t for *_, t in inside))
    assert {(r["doc_id"], r["seg_idx"]): (r["state"], r["first_new"], r["last_new"]) for r in placed.collect()} == want
    assert {(r["doc_id"], r["new_idx"]): (r["n_old"], r["target"]) for r in alignment.reused(placed, n).collect()} == carried and carried
