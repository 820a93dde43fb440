"""Stage answers against the rules of their records."""

import json

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import normalize as N


def answer(**fields):
    return json.dumps({"decision": "candidate", "evidence_ids": ["e1"], "confidence": 0.5, "cwe_id": 79, "location": {"file": "a/b.py", "function": "f"}, "source": "s"} | fields)


STAGE1 = [
    (answer(), "candidate", []), ("not json", "inconclusive", ["invalid_payload"]), ("[1]", "inconclusive", ["invalid_payload"]), (None, "inconclusive", ["invalid_payload"]),
    (answer(confirmed=True), "inconclusive", ["forbidden_field"]), (answer(decision="confirmed"), "inconclusive", ["forbidden_field"]), (answer(decision="vulnerable"), "inconclusive", ["invalid_decision"]),
    (answer(decision=None, finding="Vulnerable"), "inconclusive", ["legacy_verdict_rejected"]), (answer(decision=3), "inconclusive", ["invalid_decision"]), (answer(evidence_ids="e1"), "inconclusive", ["invalid_type"]),
    (answer(evidence_ids=[{"a": 1}]), "inconclusive", ["invalid_type"]), (answer(evidence_ids=["e1", "e9"]), "inconclusive", ["unknown_evidence_id"]), (answer(confidence="high"), "inconclusive", ["invalid_type"]),
    (answer(guards="x"), "inconclusive", ["invalid_type"]), (answer(location={"file": "../x"}), "candidate", ["invalid_location_file"]), (answer(location={"file": "~/x"}), "candidate", ["invalid_location_file"]),
    (answer(cwe_id=[1]), "inconclusive", ["invalid_type"]), (answer(evidence_ids=[]), "inconclusive", ["missing_evidence"]), (answer(decision="no_finding", evidence_ids=None), "no_finding", []), (answer(cwe_id="CWE-89"), "candidate", []),
]


def test_detection(spark):
    rows = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(STAGE1)], "k int, raw string").select("k", N.detection_result(F.col("raw"), F.array(F.lit("e1"), F.lit("e2"))).alias("r"))
    got = {r.k: r.r for r in rows.collect()}
    assert [(got[k].decision, list(got[k].faults)) for k in range(len(STAGE1))] == [(d, f) for _, d, f in STAGE1]
    assert (got[0].cwe_id, got[0].file, got[0].function, got[0].confidence, list(got[0].evidence_ids)) == ("79", "a/b.py", "f", 0.5, ["e1"])
    assert list(got[11].evidence_ids) == ["e1"] and got[11].confidence == 0.5 and got[11].source == "" and got[14].file == "" and got[19].cwe_id == "CWE-89"


PATH = {"verified_source": "a", "propagation": "b", "sink": "c", "impact": "d"}
ROLES = [json.dumps({"evidence_id": "r1", "kind": "source_sink", "role": "Impact", "content": {"covers": ["propagation"]}}), json.dumps({"evidence_id": "c1", "kind": "note", "content": {"guard_valid": True}}), json.dumps({"evidence_id": "n1", "kind": "note"})]


def verified(**fields):
    return json.dumps({"decision": "confirmed", "evidence_ids": ["r1"], "confidence": 1} | PATH | fields)


STAGE2 = [
    (verified(), "succeeded", "succeeded", "confirmed", []), (verified(), "failed", "failed", "inconclusive", []), (json.dumps({"reason": "budget"}), "skipped", "skipped", "inconclusive", ["termination"]),
    ("x", "succeeded", "failed", "inconclusive", ["invalid_payload"]), (verified(verdict="x"), "succeeded", "succeeded", "inconclusive", ["forbidden_fields"]), (verified(decision="yes"), "succeeded", "succeeded", "inconclusive", ["invalid_decision"]),
    (verified(evidence_ids=[]), "succeeded", "succeeded", "inconclusive", ["missing_evidence"]), (verified(sink=" "), "succeeded", "succeeded", "inconclusive", ["missing_path_fields"]),
    (verified(evidence_ids=["n1"]), "succeeded", "succeeded", "inconclusive", ["missing_role_evidence"]), (verified(evidence_ids=["n1"], evidence_roles={r: ["n1"] for r in N.ROLES}), "succeeded", "succeeded", "confirmed", []),
    (verified(evidence_ids=["fiction"]), "succeeded", "succeeded", "inconclusive", ["unknown_evidence_id"]), (verified(decision="rejected"), "succeeded", "succeeded", "inconclusive", ["missing_counter_evidence"]),
    (verified(decision="rejected", counter_evidence_ids=["n1"]), "succeeded", "succeeded", "inconclusive", ["insufficient_counter_evidence"]), (verified(decision="rejected", counter_evidence_ids=["c1"]), "succeeded", "succeeded", "rejected", []),
    (verified(confidence="x"), "succeeded", "succeeded", "inconclusive", ["invalid_type"]), (verified(guards={}), "succeeded", "succeeded", "inconclusive", ["invalid_type"]),
]


def test_verification(spark):
    df = spark.createDataFrame([(k, a, run) for k, (a, run, *_) in enumerate(STAGE2)], "k int, raw string, run string").withColumn("table", F.array(*(N.evidence_entry(F.lit(e)) for e in ROLES)))
    got = {r.k: r.r for r in df.select("k", N.verification_result(F.col("raw"), F.col("run"), F.col("table")).alias("r")).collect()}
    assert [(got[k].execution_state, got[k].decision, list(got[k].faults)) for k in range(len(STAGE2))] == [tuple(x[2:]) for x in STAGE2]


FINE = {"unsupported": False, "build_ok": True, "timed_out": False, "harness_ok": True, "evidence_ok": True, "target_reached": True, "preconditions": True, "success_hit": False, "positive_done": True, "negative_done": True}


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, ("succeeded", "not_reproduced")), ({"success_hit": True}, ("succeeded", "reproduced")), ({"unsupported": True, "build_ok": False}, ("skipped", "inconclusive")), ({"build_ok": False}, ("failed", "inconclusive")),
        ({"timed_out": True, "success_hit": True}, ("failed", "inconclusive")), ({"evidence_ok": False}, ("failed", "inconclusive")), ({"target_reached": False}, ("succeeded", "inconclusive")), ({"negative_done": False}, ("succeeded", "inconclusive")),
    ],
)
def test_dynamic(spark, change, want):
    assert tuple(spark.range(1).select(N.dynamic_result(**{k: F.lit(x) for k, x in (FINE | change).items()}).alias("r")).first().r) == want


ORACLES = [
    ('{"type": "exit_code", "value": 3}', True), ('{"type": "exit", "equals": "4"}', False), ('{"type": "exit"}', False), ('{"type": "signal", "value": "sigsegv"}', True), ('{"type": "asan"}', True), ('{"type": "http_status", "value": 500}', True),
    ('{"type": "file_contains", "contains": "MARK"}', True), ('{"type": "return_value", "value": "42"}', True), ('{"type": "return_value"}', True), ('{"type": "raises", "value": "Error"}', True), ('{"type": "stderr_contains", "value": "MARK"}', False),
    ('{"type": "marker", "value": ""}', False), ('"MARK"', True), ('""', False), ("{}", False), ('{"type": "odd", "value": "MARK"}', False), (None, False),
]


def test_oracles(spark):
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(ORACLES)], "k int, spec string")
    harness = F.lit('{"return_repr": 42, "call_completed": true, "exception_type": "ValueError"}')
    hit = lambda begun: N.oracle_hit(F.col("spec"), F.lit(begun), F.lit(3), F.lit("MARK HTTP 500"), F.lit("SIGSEGV AddressSanitizer"), harness)
    got = df.select("k", hit(True).alias("a"), hit(False).alias("b")).orderBy("k").collect()
    assert [r.a for r in got] == [x for _, x in ORACLES] and not any(r.b for r in got)


def test_preconditions(spark):
    kind = "array<struct<precondition_id:string,supporting_evidence_ids:array<string>,status:string>>"
    rows = [([("a", ["e1"], None)], True, ["satisfied"]), ([("a", ["e1", "e9"], None), ("b", [], None)], False, ["unsatisfied", "unknown"]), ([("a", ["e1"], "unknown")], False, ["unknown"]), ([("a", [], "satisfied")], False, ["unknown"]), ([None], False, ["unknown"]), ([], True, []), (None, True, [])]
    df = spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(rows)], f"k int, p {kind}")
    got = df.select("k", N.precondition_states(F.col("p"), F.array(F.lit("e1"))).alias("r")).orderBy("k").collect()
    assert [(r.r.satisfied, list(r.r.states)) for r in got] == [x[1:] for x in rows]


def test_enhancement(spark):
    raws = ['{"related_units": [{"id": 1, "type": "calls"}, 5, {"id": "b", "relation_type": "calls", "reason": "r"}], "call_context": {"notes": ["n"]}}', '{"include_functions": [{"id": "x"}, {"id": "y", "relation_type": "uses"}], "usage_context": "u", "data_flow": {"inputs": ["i"], "tainted_variables": ["t"]}}', "5"]
    got = [r.r for r in spark.createDataFrame(list(enumerate(raws)), "k int, raw string").select("k", N.enhancement_result(F.col("raw")).alias("r")).orderBy("k").collect()]
    assert [tuple(u) for u in got[0].related_units] == [("1", "calls", ""), ("b", "calls", "r")] and got[0].relation_type == "calls" and list(got[0].notes) == ["n"]
    assert [tuple(u) for u in got[1].related_units] == [("x", "related", ""), ("y", "uses", "")] and got[1].relation_type == "mixed" and list(got[1].notes) == ["u"] and [tuple(o) for o in got[1].observations] == [("input", "i"), ("tainted_variable", "t")]
    assert list(got[2].faults) == ["invalid_payload"]
