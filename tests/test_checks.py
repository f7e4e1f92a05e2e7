"""Hash trees and their differences, and the checks of a pilot."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import checks, hash_tree

ROWS = "seed int, id string, v double, note string"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(4)


def test_differences_against_counting(spark):
    """Missing, added, changed and repeated rows, many added in one place, nulls: as multisets tell them; leaves stay short."""
    rng = random.Random(7)
    before = [(rng.randint(1, 3), f"k{i:04d}", rng.random(), rng.choice(["a", "", None])) for i in range(900)] + [(None, None, None, None)] * 3 + [(1, "same", 1.0, "x")] * 200
    after = [r for r in before if rng.random() > 0.01]
    after = [(a, b, None if rng.random() < 0.01 else c, "" if d is None and rng.random() < 0.02 else d) for a, b, c, d in after] + [(2, f"k0500-{i}", 0.5, "new") for i in range(300)]
    held = hash_tree.leaves(table(spark, before), ["seed", "id"], 20)
    assert max(r["count"] for r in held.entries.groupBy("leaf").count().collect()) == 20
    for a, b in ((before, after), (after, before), (before, before), ([], after), (before, [])):
        expect, (x, y) = {}, (Counter(a), Counter(b))
        for row in x | y:
            if x[row] != y[row]:
                told = expect.setdefault(row[:2], [0, 0])
                told[0], told[1] = told[0] + x[row], told[1] + y[row]
        found = hash_tree.differences(table(spark, a), table(spark, b), ["seed", "id"], 20, 4).collect()
        assert {(r.seed, r.id): [r.n_before, r.n_after] for r in found} == expect and len(found) == len(expect)
        assert all(r.change == ("missing" if not r.n_after else "added" if not r.n_before else "changed") for r in found)


def test_differences_send_on_only_rows_of_slots_that_differ(spark):
    """Of many equal rows, and one repeated otherwise in each table, slots without a difference are not told."""
    same = [(i % 3, f"k{i}", float(i), None) for i in range(3000)] + [(9, "hot", 0.5, None)] * 100000
    before, after = [*same, (1, "a", 1.0, None), (1, "a", 1.0, None)], [*same, (1, "a", 2.0, None), (1, "a", 2.0, None)]
    a, b = (hash_tree.slotted(table(spark, rows), ["seed", "id"], 1 << 16) for rows in (before, after))
    wanted = {r.slot for r in a.where("key.id IN ('a', 'hot')").select("slot").distinct().collect()}
    found = hash_tree.differing(a, b, 64).collect()
    told = {r.word * 64 + i for r in found for i in range(64) if r.bits >> i & 1}
    assert told <= wanted and {r.slot for r in a.where("key.id = 'a'").select("slot").distinct().collect()} <= told
    assert [tuple(r) for r in hash_tree.differences(table(spark, before), table(spark, after), ["seed", "id"]).collect()] == [(1, "a", "changed", 2, 2)]


def test_root_is_of_the_rows(spark):
    rows = [(i % 3, f"k{i}", float(i), None) for i in range(500)]
    roots = [tuple(hash_tree.root(df, ["seed", "id"], 16, 4).first()) for df in (table(spark, rows), table(spark, rows[::-1]).repartition(9), table(spark, [*rows[:-1], (2, "k499", 499.5, None)]), table(spark, rows[:0]))]
    assert roots[0] == roots[1] != roots[2] and roots[3] == (0, "") and roots[0][0] == 500


FORMS = {
    "index": "candidate_id long, seed int", "pilot": "candidate_id long, split string, has_gold boolean",
    "calls": "call_id long, run_id string, expected_run string, started long, declared long, attempt int, waited double, cached boolean, fields array<string>",
    "ledgers": "mode string, repeat int, identity string, n long", "pairs": "mode string, candidate_id long, status1 string, status2 string, verdict1 string, verdict2 string",
    "emissions": "candidate_id long, safe boolean, emitted boolean", "settings": "selected double, recorded double",
}
SOUND = {
    "index": [(i, i) for i in range(8)], "pilot": [(1, "development", True), (2, "development", True)],
    "calls": [(10, "r", "r", 5, 3, 1, None, False, ["sentence"]), (11, "r", "r", 9, 3, 2, 2.0, False, ["tokens", "candidate"]), (12, "r", "r", 15, 3, 3, 3.96, False, [])],
    "ledgers": [("simple", 1, "a", 2), ("simple", 2, "b", 2), ("corrective", 1, "c", 2), ("corrective", 2, "d", 2)],
    "pairs": [(m, i, "valid_response", "valid_response", "KEEP", "KEEP") for m in ("simple", "corrective") for i in (1, 2)],
    "emissions": [(1, True, True), (2, False, False)], "settings": [(0.5, 0.5)],
}
#: check, table, row, field, value that makes it fail, and the least key told
FAULTS = [
    ("development-only-inputs", "pilot", 1, 1, "train", "2"), ("full-development-index", "index", 3, 1, 4, None), ("predeclared-pilot-subset", "calls", 1, 4, 9, "11"),
    ("live-capture-provenance", "calls", 0, 1, None, "10"), ("retry-error-policy", "calls", 2, 6, 3.9, "12"), ("retry-error-policy", "calls", 2, 5, 4, "12"), ("gold-pairing", "pilot", 0, 2, None, "1"),
    ("development-threshold", "settings", 0, 1, 0.6, None), ("prompt-evidence-separation", "calls", 0, 8, ["sentence", "gold"], "10"), ("simple-independent-calls", "ledgers", 1, 2, "a", None),
    ("corrective-independent-calls", "ledgers", 3, 2, "c", None), ("response-schema", "pairs", 2, 3, "malformed", "1"), ("no-cache-reuse", "calls", 1, 7, True, "11"),
    ("correction-emission-safety", "emissions", 1, 2, True, "2"), ("simple-two-call-determinism", "pairs", 1, 5, "DISCARD", "2"), ("corrective-two-call-determinism", "pairs", 2, 4, None, "1"),
    ("paired-condition-universe", "ledgers", 2, 3, 1, None),
]


def test_every_check_fails_alone(spark):
    def told(tables):
        return checks.pilot_gate({n: spark.createDataFrame(rows, FORMS[n]) for n, rows in tables.items()}).collect()

    sound = told(SOUND)
    assert len(sound) == 16 == len({r.check for r in sound}) and all(r.status == "pass" and r.all_passed for r in sound)
    for name, where, row, at, value, key in FAULTS:
        rows = [list(r) for r in SOUND[where]]
        rows[row][at] = value
        found = told(SOUND | {where: [tuple(r) for r in rows]})
        failed = [(r.check, r.n_wrong, r.first_wrong) for r in found if r.status == "fail"]
        assert failed == [(name, 1, key)] and not any(r.all_passed for r in found), name
    assert {f[0] for f in FAULTS} == {r.check for r in sound}


def test_a_table_is_read_once(spark):
    tables = {n: spark.createDataFrame(rows, FORMS[n]) for n, rows in SOUND.items()}
    plan = checks.pilot_gate(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LogicalRDD" in line or "LocalRelation" in line for line in plan.splitlines()) == len(tables)
