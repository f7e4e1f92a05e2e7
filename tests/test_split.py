"""The multilabel split against its rule, told of each dealt row and of small cases dealt by hand."""

import random
import uuid
from collections import Counter

import pytest

from spanloom.operators import split

ITEMS = "id string, labels array<string>, rank double"


def frame(spark, items):
    return spark.createDataFrame([(i, labels, rank) for i, (labels, rank) in items.items()], ITEMS).repartition(5)


def broken_rules(items, dealt, development):
    """Rows that went to a full fold, or to one that wanted them less than the other did. A row's turn is that of its label in
    `rounds_of`, then its rank; what a fold still wants then is its share less the rows of the label before it."""
    sets = Counter(tuple(sorted(set(labels))) for labels, _ in items.values() if labels)
    turn = {s: k for k, (_, part) in enumerate(split.rounds_of(dict(sets))) for s in part}
    by = {s: label for label, part in split.rounds_of(dict(sets)) for s in part}
    order = sorted(items, key=lambda i: (turn.get(tuple(sorted(set(items[i][0]))), len(turn)), items[i][1], i))
    rooms = (len(items) - development, development)
    wrong, ties = [], 0
    for k, i in enumerate(order):
        label = by.get(tuple(sorted(set(items[i][0]))))
        before = order[:k]
        scores = []
        for fold, room in zip(split.FOLDS, rooms, strict=True):
            own = sum(dealt[j] == fold for j in before)
            all_, gone = sum(label in x for x, _ in items.values()), sum(dealt[j] == fold and label in items[j][0] for j in before)
            quota = round(all_ * room / len(items) - gone, 9) if label else 0
            scores.append((room > own, quota, room - own))
        mine, other = scores if dealt[i] == "train" else scores[::-1]
        ties += mine == other
        if mine < other:
            wrong.append(i)
    return wrong, ties


@pytest.mark.parametrize("seed,n,development,bare", [(42, 300, 45, 20), (1, 60, 30, 0), (5, 33, 1, 8), (9, 200, 150, 50), (3, 64, 32, 40)])
def test_split_keeps_the_rule(spark, seed, n, development, bare):
    rng = random.Random(seed)
    names = [f"l{i}" for i in range(7)]
    items = {f"id{i:04d}": ([] if i < bare else rng.sample(names, rng.choice([1, 1, 2, 3])), rng.random()) for i in range(n)}
    found = {r.id: r.fold for r in split.multilabel_split(frame(spark, items), development, random.Random(seed)).collect()}
    assert found.keys() == items.keys() and Counter(found.values())["development"] == development
    assert broken_rules(items, found, development)[0] == []


def test_cases_by_hand(spark):
    """Quotas 3 and 1 of four rows: train leads by two, then turns. Bare rows fill what is left; a lot decides only the even pair."""
    items = {f"a{i}": (["x"], float(i)) for i in range(4)} | {f"b{i}": ([], float(i)) for i in range(4)}
    found = {r.id: r.fold for r in split.multilabel_split(frame(spark, items), 2, random.Random(1)).collect()}
    assert [found[f"a{i}"] for i in range(3)] == ["train", "train", "train"] or found["a2"] != found["a3"]
    assert Counter(found.values()) == {"train": 6, "development": 2}
    kinds = [(r.kind, r.fold, r.length) for r in split.runs_of(8, [5.5, 2.5], [60, 20], random.Random(1))]
    assert kinds == [("all", 0, 3), ("turns", 0, 5)]
    kinds = [(r.kind, r.fold, r.length) for r in split.runs_of(9, [4.25, 4.0], [9, 2], random.Random(1))]
    assert kinds == [("turns", 0, 4), ("all", 0, 5)]
    lots = split.runs_of(6, None, [3, 3], random.Random(4))
    draws = random.Random(4)
    assert [(r.kind, r.length, r.lots) for r in lots] == [("lots", 6, bytes([sum(draws.randrange(2) << i for i in range(3))]))]
    assert split.runs_of(5, None, [0, 9], random.Random(1)) == [split.Run(0, 5, 1)]


def test_lots_are_told_by_bits(spark):
    """All rows by lot, over several bytes: every pair has one row in either fold, the first as drawn."""
    items = {f"i{i:03d}": ([], float(i)) for i in range(60)}
    found = {r.id: r.fold for r in split.multilabel_split(frame(spark, items), 30, random.Random(7)).collect()}
    draws = random.Random(7)
    for pair in range(30):
        first = draws.randrange(2)
        assert (found[f"i{2 * pair:03d}"], found[f"i{2 * pair + 1:03d}"]) == (split.FOLDS[first], split.FOLDS[1 - first])


def test_runs_do_not_grow_with_the_rows():
    for n in (10**3, 10**6, 10**9):
        assert len(split.runs_of(n, [n * 0.85, n * 0.15], [n, n // 3], random.Random(1))) <= 4
        assert len(split.runs_of(n, [0.4, 0.1], [n, n - 1], random.Random(1))) <= 4
    assert len(split.runs_of(10**6, None, [10**6, 10**6], random.Random(1))) == 1


def test_official_boundary(spark):
    rng = random.Random(3)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(30)]
    items = spark.createDataFrame([(i, rng.sample(["a", "b", "c"], k % 3)) for k, i in enumerate(ids[:24])], "id string, labels array<string>")
    test = spark.createDataFrame([(i,) for i in ids[24:]], "id string")
    sizes = {"train_size": 20, "development_size": 4, "test_size": 6}
    assert Counter(r.fold for r in split.official_split(items, test, **sizes).collect()) == {"train": 20, "development": 4, "test": 6}
    for wrong in (items.limit(23), items.limit(23).unionByName(items.limit(1).selectExpr("upper(id) AS id", "labels")), items.limit(23).unionByName(test.limit(1).selectExpr("id", "array('a') AS labels"))):
        with pytest.raises(ValueError):
            split.official_split(wrong, test, **sizes)
    with pytest.raises(ValueError):
        split.official_split(items, test)
