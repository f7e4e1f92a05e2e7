"""The attempt ladder, final verdicts and the reconciliation on literal rows."""

import json

from spanloom.operators import verdicts as ops

WORDS = "the wall of the house".split()
OWN = ("wall", "object", "part-of", "house", "object")
FIX = {"head_text": "house", "head_type": "object", "relation": "necessity", "tail_text": "wall", "tail_type": "object"}


def body(content):
    return json.dumps({"message": {"content": content if isinstance(content, str) else json.dumps(content)}, "eval_count": 3})


def verdict(action, reason="SUPPORTED", **more):
    return body({"action": action, "reason_code": reason, **more})


def interpret(spark, rows, mode="corrective"):
    schema = "i int, transport_status string, http_status int, raw string, words array<string>, own struct<head_text:string,head_type:string,relation:string,tail_text:string,tail_type:string>"
    frame = spark.createDataFrame([(i, t, h, raw, WORDS, OWN) for i, (t, h, raw) in enumerate(rows)], schema)
    return [(r.response_status, r.error_category, r.action, r.correction_status) for r in ops.interpreted(frame, mode, ["object"], ["part-of", "necessity"]).orderBy("i").collect()]


def test_corrective_ladder(spark):
    cases = [
        (("timeout", None, None), ("timeout_exhausted", "timeout", None, None)),
        (("error", None, None), ("transport_exhausted", "transport", None, None)),
        (("response", 500, "{}"), ("transport_exhausted", "transport", None, None)),
        (("response", 200, "<html>"), ("malformed", "non_json_http_response", None, None)),
        (("response", 200, "[1]"), ("malformed", "non_json_http_response", None, None)),
        (("response", 200, '{"message":{"content":7}}'), ("schema_invalid", "missing_message_content", None, None)),
        (("response", 200, body("")), ("schema_invalid", "missing_message_content", None, None)),
        (("response", 200, body("KEEP it")), ("malformed", "malformed", None, "not_applicable")),
        (("response", 200, body([1])), ("schema_invalid", "schema_invalid", None, "not_applicable")),
        (("response", 200, verdict("KEEP")), ("schema_invalid", "schema_invalid", None, "not_applicable")),
        (("response", 200, verdict("KEEP", corrected=None)), ("valid_response", None, "KEEP", "not_applicable")),
        (("response", 200, verdict("KEEP", corrected=None, x=1)), ("schema_invalid", "schema_invalid", None, "not_applicable")),
        (("response", 200, verdict("KEEP", "BECAUSE", corrected=None)), ("schema_invalid", "schema_invalid", None, "not_applicable")),
        (("response", 200, verdict("DISCARD", corrected=FIX)), ("schema_invalid", "schema_invalid", None, "not_applicable")),
        (("response", 200, verdict("CORRECT", corrected=None)), ("schema_invalid", "schema_invalid", None, "schema_invalid")),
        (("response", 200, verdict("CORRECT", corrected={**FIX, "head_type": "thing"})), ("schema_invalid", "schema_invalid", None, "schema_invalid")),
        (("response", 200, verdict("CORRECT", corrected={**FIX, "more": 1})), ("schema_invalid", "schema_invalid", None, "schema_invalid")),
        (("response", 200, verdict("CORRECT", corrected=FIX)), ("valid_response", None, "CORRECT", "valid")),
        (("response", 200, verdict("CORRECT", corrected={**FIX, "head_text": "the"})), ("valid_response", None, "CORRECT", "ambiguous")),
        (("response", 200, verdict("CORRECT", corrected={**FIX, "tail_text": "roof"})), ("valid_response", None, "CORRECT", "out_of_source")),
        (("response", 200, verdict("CORRECT", corrected={**FIX, "tail_text": "the  wall"})), ("valid_response", None, "CORRECT", "out_of_source")),
        (("response", 200, verdict("CORRECT", corrected=dict(zip(FIX, OWN)))), ("valid_response", None, "CORRECT", "schema_invalid")),
    ]
    assert interpret(spark, [c for c, _ in cases]) == [e for _, e in cases]


def test_simple_ladder(spark):
    rows = [("response", 200, verdict("KEEP")), ("response", 200, verdict("CORRECT")), ("response", 200, verdict("KEEP", corrected=None))]
    assert [r[0] for r in interpret(spark, rows, "simple")] == ["valid_response", "schema_invalid", "schema_invalid"]


def test_final_verdict_and_emission(spark):
    rows = [
        ("a", 1, "malformed", None, None), ("a", 2, "valid_response", "KEEP", "not_applicable"), ("a", 3, "valid_response", "DISCARD", "not_applicable"),
        ("b", 1, "malformed", None, None), ("b", 2, "timeout_exhausted", None, None), ("c", 1, "valid_response", "CORRECT", "valid"), ("d", 1, "valid_response", "CORRECT", "ambiguous"),
    ]
    frame = spark.createDataFrame(rows, "candidate_id string, attempt int, response_status string, action string, correction_status string")
    found = {r.candidate_id: (r.attempt, r.n_attempts, r.keeps, r.emits) for r in ops.safe_emission(ops.final_verdicts(frame, ["candidate_id"])).collect()}
    assert found == {"a": (2, 3, True, True), "b": (2, 2, False, False), "c": (1, 1, False, True), "d": (1, 1, False, False)}


def test_reconciliation(spark):
    candidates = spark.createDataFrame([(i, 42) for i in range(1, 7)], "candidate_id int, training_seed int")
    said = [(1, 42, "x"), (2, 42, "x"), (2, 42, "x"), (4, 42, "x"), (5, 42, "y"), (6, 43, "x"), (9, 42, "x")]
    asked = [(1, 42, "x"), (2, 42, "x"), (3, 42, "x"), (5, 42, "x"), (6, 42, "x")]
    schema = "candidate_id int, training_seed int, request_sha256 string"
    found = {r.candidate_id: r.state for r in ops.reconciled(candidates, spark.createDataFrame(said, schema), spark.createDataFrame(asked, schema)).collect()}
    assert found == {1: "matched", 2: "duplicate_verdict", 3: "missing_verdict", 4: "missing_request", 5: "request_differs", 6: "seed_differs", 9: "unknown_candidate"}
