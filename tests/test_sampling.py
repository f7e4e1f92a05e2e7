"""The first rows of groups by hash, against ordering each group."""

import hashlib
import random

from spanloom.operators.sampling import first_by_hash


def test_first_by_hash(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "c"]), i, hashlib.md5(str(i).encode()).hexdigest()) for i in range(3000)]
    quotas = [("a", 100), ("b", 0), (None, 37), ("c", 10**6)]
    found = first_by_hash(spark.createDataFrame(rows, "g string, i int, h string").repartition(5), ["g"], "h", spark.createDataFrame(quotas, "g string, quota long"), digits=2).collect()
    assert len(found) == len(rows)
    for g, quota in quotas:
        mine = sorted((h, i) for x, i, h in rows if x == g)
        assert {r.i for r in found if r.g == g and r.chosen} == {i for _, i in mine[:quota]}
