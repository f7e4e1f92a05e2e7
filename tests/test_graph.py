"""Retrieval order, caps, visited nodes and the word fallback."""

from spanloom.operators import graph as ops

EDGES = [(0, "Door", "part-of", "Wall"), (1, "wall", "part-of", "House"), (2, "Door", "part-of", "Wall"), (3, "House", "in", "Street"), (4, "fire door", "is", "Door")]


def facts(spark, edges, q, hops):
    frame = spark.createDataFrame(edges, "edge_pos long, head string, relation string, tail string").repartition(3)
    asked = spark.createDataFrame([(q,)], "q string")
    found = ops.hop(ops.seeds(asked, ops.nodes(frame)), frame, asked, hops).orderBy("place").collect()
    return [(r.head, r.tail) for r in found]


def test_first_appearance_and_dedup(spark):
    assert facts(spark, EDGES, "door", 1) == [("Door", "Wall"), ("fire door", "Door")]


def test_second_hop_follows_new_edges(spark):
    assert facts(spark, EDGES, "Street", 1) == [("House", "Street")]
    assert facts(spark, EDGES, "Street", 2) == [("House", "Street"), ("wall", "House")]


def test_cap(spark):
    edges = [(i, "hub", "r", f"n{i:02d}") for i in range(30)]
    assert facts(spark, edges, "hub", 1) == [("hub", f"n{i:02d}") for i in range(15)]


def test_fallback_only_without_substring(spark):
    frame = spark.createDataFrame(EDGES, "edge_pos long, head string, relation string, tail string")
    asked = spark.createDataFrame([("door fire",), ("wall",), ("nothing here",)], "q string")
    found = {(r.q, r.node, r.rule) for r in ops.seeds(asked, ops.nodes(frame)).collect()}
    assert ("door fire", "fire door", "words") not in found and ("door fire", "door", "substring") in found
    assert ("wall", "wall", "substring") in found and not any(q == "nothing here" for q, _, _ in found)
    words = ops.seeds(spark.createDataFrame([("street big",)], "q string"), ops.nodes(frame.where("edge_pos <> 3").unionByName(spark.createDataFrame([(9, "the street", "in", "Town")], frame.schema)))).collect()
    assert [(r.node, r.rule) for r in words] == [("the street", "words")]


def test_empty_query_matches_every_node(spark):
    frame = spark.createDataFrame(EDGES, "edge_pos long, head string, relation string, tail string")
    assert ops.seeds(spark.createDataFrame([("",)], "q string"), ops.nodes(frame)).count() == 5


def test_containing_finds_every_substring(spark):
    """Against a scan of all pairs: short strings, empty ones, repeats, and letters beyond the first plane."""
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("ab c🙂é") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    short, whole = words[:70] + ["", "a"], words[40:] + ["abab", ""]
    found = ops.containing(spark.createDataFrame([(w,) for w in short], "s string"), spark.createDataFrame([(w,) for w in whole], "l string")).collect()
    assert len(found) == len({(r.s, r.l) for r in found})
    assert {(r.s, r.l) for r in found} == {(a, b) for a in short for b in whole if a in b}


def test_seed_join_has_no_nested_loop(spark):
    frame = spark.createDataFrame(EDGES, "edge_pos long, head string, relation string, tail string")
    plan = ops.seeds(spark.createDataFrame([("door",), ("wall",)], "q string"), ops.nodes(frame))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("Cross" not in line and "=" in line for line in joins)


def test_words_are_split_at_any_white_space(spark):
    frame = spark.createDataFrame([(0, "fire\u00a0door\texit", "in", "Hall")], "edge_pos long, head string, relation string, tail string")
    found = ops.seeds(spark.createDataFrame([("exit\u2003sign",)], "q string"), ops.nodes(frame)).collect()
    assert [(r.node, r.rule) for r in found] == [("fire\u00a0door\texit", "words")]


def test_best_lines_both_ways(spark, monkeypatch):
    """Counting beside broadcast questions and the inverted index give the same lines, ties included."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    lines = [(d, i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for d in range(40) for i in range(5)] + [(99, 0, None)]
    asked = [(q, sorted(set(rng.choices(vocabulary, k=8)))) for q in range(7)] + [(50, []), (51, ["absent"])]
    held = spark.createDataFrame(lines, "doc_id long, line int, content string").repartition(4)
    questions = spark.createDataFrame(asked, "q long, words array<string>")
    expect = set()
    for q, words in asked:
        scored = sorted((-len(set(words) & set((t or "").split())), d, i) for d, i, t in lines)
        expect |= {(q, d, i, -n, k) for k, (n, d, i) in enumerate(scored[:3], 1) if n}
    assert set(map(tuple, ops.best_lines(questions, held, block=4).collect())) == expect
    monkeypatch.setattr(ops, "QUESTION_CELLS", 0)
    assert set(map(tuple, ops.best_lines(questions, held).collect())) == expect
