"""Markdown cells, nested paths and digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanloom.operators import lineage, report


def test_markdown(spark):
    df = spark.createDataFrame([("b|c", 1.5), ("a\nb", None)], "name string, v double")
    assert [r.line for r in report.markdown(df, ["name"]).orderBy("place").collect()] == ["| name | v |", "|---|---|", "| a<br>b | NA |", "| b\\|c | 1.5 |"]


def test_flattened_paths(spark):
    schema = "run string, a struct<x:int,y:array<struct<z:int>>>, m map<string,array<int>>, n array<int>, e struct<q:int>"
    df = spark.createDataFrame([("r", (1, [(2,), (None,)]), {"k": [7, 8]}, None, None)], schema)
    found = {r.path: r.value for r in report.flattened(df, "run").collect()}
    assert found == {"r.a.x": "1", "r.a.y[0].z": "2", "r.a.y[1].z": "unavailable", "r.m.k[0]": "7", "r.m.k[1]": "8", "r.n": "unavailable", "r.e": "unavailable"}


def test_digest_does_not_depend_on_the_deal(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.concat(F.lit("row"), "id").alias("row"))
    a, b = ({r.g: (r.n, r.digest) for r in report.digest(x, ["g"], "id", "row").collect()} for x in (df, df.repartition(7)))
    assert a == b and len(set(a.values())) == 3
    parts = {}
    for i in range(0, 500, 3):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        parts.setdefault(h[:3], []).append((h, f"row{i}"))
    whole = "\n".join(f"{p}:{hashlib.sha256(chr(10).join(r for _, r in sorted(rows)).encode()).hexdigest()}" for p, rows in sorted(parts.items()))
    assert a[0] == (167, hashlib.sha256(whole.encode()).hexdigest())


def test_closure_of_a_graph(spark):
    """A diamond over a long chain: least distances, every ancestor once, and faults that spread to what descends from them."""
    links = [(i, i - 1) for i in range(1, 40)] + [(50, 39), (51, 39), (52, 50), (52, 51), (7, 3)]
    found = {(r.child, r.ancestor): r.depth for r in lineage.closure(spark.createDataFrame(links, "child int, parent int")).collect()}
    above = {}
    for child, parent in links:
        above.setdefault(child, []).append(parent)
    expect = {}
    for start in above:
        todo, depth = {start}, 0
        while todo:
            depth += 1
            todo = {p for c in todo for p in above.get(c, [])}
            for p in todo:
                expect.setdefault((start, p), depth)
    assert found == expect
    rows = [(1, "h1", None, None), (2, "h2", 1, "h1"), (3, "h3", 2, "old"), (4, "h4", 3, "h3"), (5, "h5", 9, "h9")]
    judged = {r.id: (r.n_ancestors, r.n_broken, r.valid) for r in lineage.validated(spark.createDataFrame(rows, "id int, sha256 string, parent int, parent_sha256 string")).collect()}
    assert judged == {1: (0, 0, True), 2: (1, 0, True), 3: (2, 1, False), 4: (3, 1, False), 5: (1, 1, False)}


def test_totals_without_pairs(spark):
    """A chain of 300, a tree and a lone artifact: counts, faults and the oldest, each row once; a circle is refused."""
    links = [(i, i - 1, i % 7 == 0) for i in range(1, 300)] + [(1000 + i, 1000 + i // 2, i == 5) for i in range(2, 60)]
    found = {r.child: (r.n_ancestors, r.n_broken, r.oldest) for r in lineage.totals(spark.createDataFrame(links, "child int, parent int, broken boolean")).collect()}
    above = {c: (p, b) for c, p, b in links}
    for child, told in found.items():
        seen, at = [], child
        while at in above:
            seen.append(above[at])
            at = above[at][0]
        assert told == (len(seen), sum(b for _, b in seen), min(p for p, _ in seen))
    assert len(found) == len(links)
    with pytest.raises(RuntimeError):
        lineage.totals(spark.createDataFrame([(1, 2, False), (2, 1, False)], "child int, parent int, broken boolean"), most=5)


def test_judged_with_several_parents(spark):
    """A diamond under a chain, an absent parent, a fault in one arm alone: against a walk from each artifact."""
    links = [(2, 1, False), (3, 1, True), (4, 2, False), (4, 3, False), (5, 2, False), (6, 5, False), (6, 1, False), (7, 99, True), (8, 7, False), (8, 6, False)]
    frame = spark.createDataFrame(links, "child int, parent int, broken boolean")
    found = {r.id: (r.generation, r.n_broken, r.valid, r.oldest) for r in lineage.judged(frame, spark.range(1, 10).selectExpr("cast(id AS int) AS id")).collect()}
    assert found == {1: (0, 0, True, 1), 2: (1, 0, True, 1), 3: (1, 1, False, 1), 4: (2, 0, False, 1), 5: (2, 0, True, 1), 6: (3, 0, True, 1), 7: (0, 1, False, 7), 8: (4, 0, False, 1), 9: (0, 0, True, 9)}
