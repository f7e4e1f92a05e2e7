import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import ngram_join
from tests.llm import cases


def brute(rows, rule):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = cases.words((r[1] or "").translate(lower))
        n = rule.words
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.of * both >= rule.least * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        low[root(i)] = min(low.get(root(i), 2**63 - 1), ids[i])
    named = [low[root(i)] if sets[i] else ids[i] for i in range(len(rows))]
    none = lambda x: None if x == 2**63 - 1 else x
    return sorted(((none(i), len(s), none(c)) for i, s, c in zip(ids, sets, named)), key=str)


def result(df, rule):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, rule).collect()), key=str)


@pytest.mark.parametrize("rule", [ngram_join.Rule(4, 85), ngram_join.Rule(5, 80)])
def test_odd_cases(spark, rule):
    rows = cases.odd_rows()
    assert result(cases.frame(spark, rows), rule) == brute(rows, rule)


def test_chained_near_copies(spark):
    """Groups whose members drift apart, so that most pairs do not link and hubs alone would miss links."""
    rng, rows = random.Random(9), []
    for g in range(4):
        text = cases.sentence(rng, 90).split()
        for i in range(14):
            text = list(text)
            text[rng.randrange(len(text))] = f"new{g}x{i}"
            rows.append((g * 100 + rng.randrange(1000) * 1000, " ".join(text), *[None] * 6))
    rule = ngram_join.Rule(4, 85)
    assert result(cases.frame(spark, rows), rule) == brute(rows, rule)


def test_one_of_each_keeps_columns(spark):
    df = cases.frame(spark, [r for r in cases.odd_rows() if r[0] != 15])
    left = ngram_join.one_of_each(df, ngram_join.Rule(5, 80))
    assert left.columns == df.columns and 0 < left.count() < df.count()


def test_empty_table(spark):
    assert result(cases.frame(spark, []).limit(0), ngram_join.Rule()) == []


def test_hot_shingles_come_in_parts(spark, monkeypatch):
    """With a low bound every frequent shingle is dealt in several parts, and no link is lost."""
    monkeypatch.setattr(ngram_join, "HOT", 1)
    rng, rows = random.Random(3), []
    template = cases.sentence(rng, 60).split()
    for i in range(60):
        text = list(template)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"v{rng.randrange(5)}"
        rows.append((i, " ".join(text), *[None] * 6))
    rows += [(100 + i, " ".join(template[:5]), *[None] * 6) for i in range(3)]
    rule = ngram_join.Rule(4, 85)
    assert result(cases.frame(spark, rows), rule) == brute(rows, rule)


def test_components_over_many_tasks(spark):
    """Trees of several tasks are joined by rounds: long paths, stars and repeats."""
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(150)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links + links[:50], "a long, b long").repartition(6)
    found = {r.node: r.root for r in ngram_join.components(frame, edges_a_task=40).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {x: root(x) for x in parent}


def test_one_of_each_of_rows_without_ids(spark):
    """Rows without an id are documents of their own: of near copies one stays; all columns are kept, whatever their names."""
    rng = random.Random(2)
    text = cases.sentence(rng, 80)
    rows = [(None, text, 1), (None, text + " more", 2), (None, cases.sentence(rng, 80), 3), (4, text + " end", 4), (5, None, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long").withColumn("__id", F.lit(99)).withColumn("row", F.lit("r"))
    left = ngram_join.one_of_each(df, ngram_join.Rule(5, 80))
    assert left.columns == df.columns
    assert sorted((r.key, r.__getitem__("__id"), r.row) for r in left.collect()) == [(3, 99, "r"), (4, 99, "r"), (5, 99, "r"), (6, 99, "r")]


def test_many_rows_without_ids(spark):
    """Near copies without ids link, also with rows that repeat an id, each by its own text."""
    rng = random.Random(12)
    rows = []
    for _ in range(60):
        text = cases.sentence(rng, 90)
        rows += [(None, text, *[None] * 6), (None, text + " more", *[None] * 6)]
    rows += [(5, rows[0][1] + " end", *[None] * 6), (5, cases.sentence(rng, 50), *[None] * 6)]
    found = ngram_join.join(cases.frame(spark, rows), ngram_join.Rule())
    told = [r.component_id for r in found.collect()]
    assert told.count(5) == 4 and told.count(None) == 118  # those of the one group with an id, and the rest
