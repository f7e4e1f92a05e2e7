"""Range structures give what a walk over each range gives."""

import random

from spanloom.operators import pooling


def test_spans_and_gaps_equal_plain_walks(spark):
    draw = random.Random(5)
    sizes = {1: 1, 2: 2, 3: 37, 4: 8}
    words = {s: [[draw.uniform(-9, 9) for _ in range(3)] for _ in range(n)] for s, n in sizes.items()}
    states = spark.createDataFrame([(s, i, v) for s, vs in words.items() for i, v in enumerate(vs)], "sentence int, at int, state array<double>").repartition(5)
    spans = [(s, a, b) for s, n in sizes.items() for a in range(n) for b in range(a, n)]
    held = pooling.ranges(states, 3, 37)
    found = pooling.span_states(held, spark.createDataFrame([*spans, (2, 1, 0), (1, 0, 5), *spans[:3]], "sentence int, start int, end int"))
    got = {(r.sentence, r.start, r.end): r.state for r in found.collect()}
    assert got == {(s, a, b): words[s][a] + words[s][b] + [max(c) for c in zip(*words[s][a : b + 1])] for s, a, b in spans}

    pairs = [(3, *draw.sample(range(37), 1) * 2, *draw.sample(range(37), 1) * 2) for _ in range(60)] + [(4, 0, 3, 2, 5), (4, 0, 1, 2, 3), (4, 0, 0, 7, 7), (4, 7, 7, 0, 0), (1, 0, 0, 0, 0)]
    for r in pooling.between_states(held, spark.createDataFrame(pairs, "sentence int, s1 int, e1 int, s2 int, e2 int"), 3).collect():
        inner = words[r.sentence][min(r.e1, r.e2) + 1 : max(r.s1, r.s2)]
        expect = [sum(c) / len(inner) for c in zip(*inner)] if inner else [0.0] * 3
        assert max(abs(a - b) for a, b in zip(r.state, expect)) < 1e-9


def test_one_shuffle_of_the_states(spark):
    states = spark.createDataFrame([(1, 0, [1.0, 2.0])], "sentence int, at int, state array<double>")
    plan = pooling.ranges(states, 2, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert pooling.ranges(states.where("false"), 2, 4).count() == 0
