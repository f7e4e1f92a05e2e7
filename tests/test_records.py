"""Ledgers bound by id: every rule broken once, and sets counted by hand."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import records as ops

PREPARED = """example_id string, source_id string, content string, words array<string>, spans array<struct<start:int,end:int,type:string>>,
relations array<struct<relation:string,head:struct<start:int,end:int>,tail:struct<start:int,end:int>>>"""
SPANS = [(0, 0, "object"), (1, 2, "property")]
LINK = ("part-of", (0, 0), (1, 2))

CASES = {
    "sound": ("d", "a door has", ["a", "door", "has"], SPANS, [LINK], None),
    "pieces": ("d", "a door-has it", ["a", "door", "-", "has", "it"], SPANS, [LINK], None),
    "no_lists": ("d", "a door", ["a", "door"], None, None, None),
    "no_source": (None, "a", ["a"], [], [], "malformed"),
    "no_content": ("d", None, ["a"], [], [], "malformed"),
    "no_words": ("d", "", [], [], [], "malformed"),
    "null_words": ("d", "a", None, [], [], "malformed"),
    "null_word": ("d", "a", ["a", None], [], [], "malformed"),
    "empty_word": ("d", "a", ["a", ""], [], [], "malformed"),
    "order": ("d", "door a", ["a", "door"], [], [], "unaligned"),
    "once": ("d", "a door", ["a", "door", "door"], [], [], "unaligned"),
    "overlap": ("d", "aba", ["ab", "ba"], [], [], "unaligned"),
    "beyond": ("d", "a b", ["a", "b"], [(0, 2, "object")], [], "span_outside"),
    "backward": ("d", "a b", ["a", "b"], [(1, 0, "object")], [], "span_outside"),
    "open": ("d", "a b", ["a", "b"], [(0, None, "object")], [], "span_outside"),
    "type": ("d", "a b", ["a", "b"], [(0, 1, "thing")], [], "span_outside"),
    "relation": ("d", "a b c", ["a", "b", "c"], SPANS, [("like", (0, 0), (1, 2))], "relation_outside"),
    "end": ("d", "a b c", ["a", "b", "c"], SPANS, [("part-of", (0, 0), (1, 1))], "relation_outside"),
    "no_end": ("d", "a b c", ["a", "b", "c"], SPANS, [("part-of", (0, 0), None)], "relation_outside"),
    "long": ("d", "x " * 20_000 + "y", ["x"] * 20_000 + ["y"], [], [], None),
}


def test_prepared_problems(spark):
    rows = [(k, *v[:-1]) for k, v in CASES.items()]
    again = [("twice", "d", "a", ["a"], [], [])] * 2 + [(None, "d", "a", ["a"], [], [])] * 2 + [("", "d", "a", ["a"], [], [])]
    found = ops.prepared_problems(spark.createDataFrame(rows + again, PREPARED), ["object", "property"], ["part-of"]).collect()
    told = {r.example_id: r.problem for r in found if r.example_id in CASES}
    assert told == {k: v[-1] for k, v in CASES.items()}
    assert sorted(("~" if r.example_id is None else r.example_id, r.problem) for r in found if r.example_id not in CASES) == [("", "malformed"), ("twice", "repeated_id"), ("twice", "repeated_id"), ("~", "malformed"), ("~", "malformed")]


def test_evaluator_rows(spark):
    prepared = spark.createDataFrame([("a", "A door."), ("b", "B."), ("b", "B."), ("c", "C.")], "example_id string, content string")
    gold = spark.createDataFrame([("a", [("door", "part-of", "A")]), ("b", []), ("d", [])], "example_id string, triples array<struct<head_text:string,relation:string,tail_text:string>>")
    split = spark.createDataFrame([("a",), ("b",), ("e",)], "example_id string")
    found = {r.example_id: r for r in ops.evaluator_rows(prepared, gold, split).collect()}
    assert {k: r.problem for k, r in found.items()} == {
        "a": None, "b": "repeated in prepared", "c": "not in gold, not in split", "d": "not in prepared, not in split", "e": "not in prepared, not in gold"}
    assert found["a"].sentence == "A door." and json.loads(found["a"].gold_triples) == [{"head_text": "door", "relation": "part-of", "tail_text": "A"}]
    assert json.loads(found["b"].gold_triples) == []
    assert ops.evaluator_rows(prepared.limit(0), gold.limit(0), split.limit(0)).collect() == []


def test_field_differences(spark):
    kind = "id int, x int, y string"
    left = spark.createDataFrame([(1, 1, "a"), (2, None, None), (3, 1, None), (4, 1, "a"), (6, 1, "a")], kind)
    right = spark.createDataFrame([(1, 1, "a"), (2, None, None), (3, 2, "b"), (5, 1, "a"), (6, None, "a")], kind)
    found = {r.id: (r.state, r.fields) for r in ops.field_differences(left, right, ["id"], ["x", "y"]).collect()}
    assert found == {1: ("same", ""), 2: ("same", ""), 3: ("differs", "x,y"), 4: ("left_only", ""), 5: ("right_only", ""), 6: ("differs", "x")}


SOUND = {"sentence": "s", "sentence_processed": "s", "sentence_tokens": ["s"], "candidate": {"head": {"text": "s"}, "relation": "r", "tail": 1}}


@pytest.mark.parametrize(
    ("text", "sound"),
    [
        (ops.INPUT_MARK + json.dumps(SOUND), True),
        ("INPUT_JSON:\n{} and then " + ops.INPUT_MARK + json.dumps(SOUND), True),  # the last mark counts
        (ops.INPUT_MARK + json.dumps(SOUND | {"gold": 1}), False),
        (ops.INPUT_MARK + json.dumps({k: v for k, v in SOUND.items() if k != "sentence"}), False),
        (ops.INPUT_MARK + json.dumps(SOUND | {"candidate": SOUND["candidate"] | {"type": 1}}), False),
        (ops.INPUT_MARK + json.dumps(SOUND | {"candidate": json.dumps(SOUND["candidate"])}), False),  # a text, no object
        (ops.INPUT_MARK + json.dumps(SOUND | {"candidate": None}), False),
        (ops.INPUT_MARK + "[1]", False),
        (ops.INPUT_MARK + "no", False),
        (json.dumps(SOUND), False),
        ("", False),
        (None, False),
    ],
)
def test_source_only(spark, text, sound):
    assert spark.createDataFrame([(text,)], "c string").select(ops.is_source_only(F.col("c"))).first()[0] is sound


def test_sets_and_unions(spark):
    kind = "split string, id int, start int, end int"
    gold = spark.createDataFrame([("a", 1, 0, 0), ("a", 1, 0, 0), ("a", 1, 2, 3), ("b", 2, 0, 1)], kind)
    said = spark.createDataFrame([("a", 1, 0, 0), ("a", 1, 4, 4), ("c", 3, 0, 0)], kind)
    found = {r.split: tuple(r)[1:] for r in ops.set_counts(gold, said, ["split"], "x").collect()}
    assert found == {"a": (1, 1, 1, 0.5), "b": (0, 0, 1, 0.0), "c": (0, 1, 0, 0.0)}
    pairs = {r.split: (r.n_union_spans, r.n_pairs) for r in ops.union_pairs(gold, said, ["id"], ["split"]).collect()}
    assert pairs == {"a": (3, 6), "b": (1, 0), "c": (1, 0)}
