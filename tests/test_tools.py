"""What reviewers may ask for, and what a blind one sees."""

import json

import pytest

from glossweave.operators import tools

F = pytest.importorskip("pyspark.sql.functions")


def _ask(*requests):
    return json.dumps({"findings": [], "evidence_requests": [{"tool": t, "arguments": a} for t, a in requests]})


@pytest.fixture(scope="module")
def tables(spark):
    segs = [(j, k, f"the field {k}" if k != 1 else "no such thing", f"target {k}", f"first {k}", f"accepted {k}" if k == 2 else None, "candidate" if k == 0 else None, "reviewed", k == 0, None) for j in (1, 2, 3) for k in range(4)]
    segs += [(4, k, "x" * 9000, "y", "z", None, None, None, None, None) for k in range(4)]
    return (
        spark.createDataFrame(segs, "job long, seg_idx int, text string, target string, initial_target string, accepted_target string, candidate string, target_provenance string, reviewed boolean, from_tm boolean"),
        spark.createDataFrame([("t1", "Field", '{"id":"t1"}', 0), ("t2", "field", '{"id":"t2"}', 1)], "id string, source string, entry string, pos int"), spark.createDataFrame([(1, '{"p":1}', '{"s":1}')], "job long, profile string, synopsis string"),
        spark.createDataFrame([(1, "u1", 0, 1, '{"u":1}', 0), (1, "u2", 1, 3, '{"u":2}', 1)], "job long, unit_id string, start_segment int, end_segment int, digest string, pos int"),
        spark.createDataFrame([(1, 0, '{"f":1}', 0), (1, 2, '{"f":2}', 1)], "job long, seg_idx int, finding string, pos int"),
    )


def _results(spark, tables, payloads):
    asked = tools.asked(spark.createDataFrame(payloads, "job long, round int, payload string, blind boolean"))
    answers = tools.answered(asked, *tables)
    found = {(r["job"], r["evidence_id"]): json.loads(r["result"]) for r in answers.collect()}
    return found, {(r["job"], r["round"], r["pos"]): (r["evidence_id"], r["deduped"], r["failed"]) for r in tools.trace(asked, answers).collect()}


def test_answers_and_trace(spark, tables):
    first = _ask(("get_segment", {"segment_id": "2"}), ("get_neighbors", {"segment_id": 0, "before": 9, "after": 1}), ("get_segment", {"segment_id": "2"}), ("find_occurrences", {"source_expression": "FIELD"}), ("get_everything", {}), ("get_findings", {}))
    more = _ask(("get_term", {"source": "FIELD"}), ("get_section_digest", {"segment_id": 1}), ("get_section_digest", {"section_id": "u2"}), ("get_findings", {"segment_id": 2}), ("get_document_synopsis", {}))
    found, trace = _results(spark, tables, [(1, 0, f"Here:\n```json\n{first}\n```", False), (2, 0, more, False), (3, 0, "{}", False)])
    whole = {"segment_id": 2, "source": "the field 2", "target": "target 2", "initial_target": "first 2", "accepted_target": "accepted 2", "target_provenance": "reviewed", "reviewed": False, "from_tm": False}
    assert found[1, "E1"] == whole and [x["segment_id"] for x in found[1, "E2"]] == [1]
    assert [x["segment_id"] for x in found[1, "E3"]] == [0, 2, 3] and "error" in found[1, "E4"] and (1, "E5") not in found
    assert trace[1, 0, 3] == ("E1", True, False) and len([k for k in trace if k[0] == 1]) == tools.MOST
    assert found[2, "E1"] == {"id": "t1"} and found[2, "E2"] == {} and found[2, "E4"] == [] and found[2, "E5"] == {}
    assert not any(k[0] == 3 for k in found)


def test_blind_reviewers_see_no_formal_target(spark, tables):
    payload = _ask(("get_segment", {"segment_id": 0}), ("get_translation_history", {"segment_id": 0}), ("get_segment", {"segment_id": 2}), ("get_findings", {}), ("get_neighbors", {"segment_id": 1, "before": 0, "after": 1}))
    found, _ = _results(spark, tables, [(1, 0, payload, True)])
    assert found[1, "E1"] == found[1, "E2"] == {"segment_id": 0, "source": "the field 0", "target": "candidate"}
    assert found[1, "E3"]["target"] == "accepted 2" and found[1, "E4"] == [] and len(found[1, "E5"]) == 1
    assert not any(x in json.dumps(list(found.values())) for x in ("first", '"target 0"', "reviewed"))


def test_bounds_and_malformed_payloads(spark, tables):
    rows = [(4, 0, _ask(("get_neighbors", {"segment_id": 1}), ("get_segment", {"segment_id": 1}), ("get_neighbors", {"segment_id": 9}), ("get_segment", {})), False), (1, 0, "[]", False), (2, 0, '{"evidence_requests": [1]}', False), (3, 0, _ask(("get_segment", {"segment_id": 0})), False)]
    found, trace = _results(spark, tables, [*rows, (3, 1, _ask(("get_segment", {"segment_id": 1})), False)])
    assert found[4, "E1"]["max_bytes"] == tools.MAX_BYTES < found[4, "E1"]["payload_bytes"] and found[4, "E2"]["segment_id"] == 1 and found[4, "E3"] == [] and found[4, "E4"] == {}
    assert trace[1, 0, 0][2] and trace[2, 0, 0][2] and "error" in found[1, "E1"]
    assert trace[3, 1, 1] == ("E2", False, True)  # the last round may not ask
    assert not trace[4, 0, 1][2]


def test_payloads_are_read_once_and_dealt_by_job(spark, tables):
    payloads = spark.createDataFrame([(1, 0, _ask(("get_segment", {"segment_id": 2}), ("get_findings", {}), ("get_segment", {"segment_id": 2})), False), (2, 0, _ask(("get_term", {"source": "field"})), True)], "job long, round int, payload string, blind boolean")
    met = []

    def deal(df, *keys):
        met.append(keys)
        return df.repartition(3, *keys)

    plain, dealt = tools.asked(payloads), tools.asked(payloads, deal=deal)
    answers = tools.answered(dealt, *tables, deal=deal)
    whole = tools.trace(dealt, answers, deal=deal)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "evidence_requests_of" not in plan and "UDTF" not in plan
    assert sorted(map(str, whole.collect())) == sorted(map(str, tools.trace(plain, tools.answered(plain, *tables)).collect()))
    assert {("job",), ("job", "n"), ("job", "seg_idx")} <= set(met)
