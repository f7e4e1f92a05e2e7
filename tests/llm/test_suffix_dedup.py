import random

import pytest

from pyspark.sql import functions as F

from spanloom.llm import runs, suffix_dedup
from tests.llm import cases


def brute(rows):
    texts = [((2**63 - 1) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for doc, t in texts:
        for i in range(len(t) - 49):
            k = t[i : i + 50]
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        out.append((None if doc == 2**63 - 1 else doc, len(t), sum(gone), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def result(df, **more):
    found = suffix_dedup.remove_repeats(df, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), bytes(r.kept)) for r in found), key=str)


def test_odd_cases(spark):
    rows = cases.odd_rows()
    assert result(cases.frame(spark, rows)) == brute(rows)


def test_many_runs_and_overlaps(spark):
    rng = random.Random(5)
    shared = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else cases.sentence(rng, 9) for _ in range(8)), *[None] * 6) for i in range(150)]
    assert result(cases.frame(spark, rows), run_bytes=4000) == brute(rows)


@pytest.mark.parametrize("fanout,most", [(3, 2), (4, 5)])
def test_levels_of_teams(spark, fanout, most):
    """Runs merged in teams over several levels remove what one level removes."""
    rng = random.Random(15)
    shared = ["".join(rng.choice("ab ") for _ in range(rng.randint(50, 90))) for _ in range(9)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else cases.sentence(rng, 9) for _ in range(6)), *[None] * 6) for i in range(90)]
    assert result(cases.frame(spark, rows), run_bytes=1500, fanout=fanout, most=most) == brute(rows)


def test_exchange_tells_what_is_shared(spark):
    """Bits and least payloads through one level and through several are those of a plain count."""
    import numpy as np

    rng = np.random.default_rng(3)
    held = [rng.integers(0, 400, 60) for _ in range(23)]
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    parts = [runs.tag_blocks(i, pool[h], h % 5 + 5 * i, runs.FANOUT, (h % 5 + 5 * i, np.arange(60))) for i, h in enumerate(held)]
    import pyarrow as pa

    tags = spark.createDataFrame(pa.concat_tables(parts).to_pandas(), runs.TAGS)
    owners, first = {}, {}
    for i, h in enumerate(held):
        for at, x in enumerate(h.tolist()):
            owners.setdefault(x, set()).add(x % 5 + 5 * i)
            first[x] = min(first.get(x, (99999, 0)), (x % 5 + 5 * i, at))
    for most in (100, 4):
        found = runs.exchange(tags, 23, runs.FANOUT, most).toPandas()
        for i, h in enumerate(held):
            bits, who, where = runs.answers(pool[h], pa.Table.from_pandas(found[found.run == i]), runs.FANOUT, (-1, -1))
            for x, bit, a, b in zip(h.tolist(), bits, who, where):
                assert bit == (len(owners[x]) > 1) and ((a, b) == (first[x] if bit else (-1, -1)))


def test_empty_table(spark):
    assert result(cases.frame(spark, []).limit(0)) == []


def test_merge_orders_and_shares():
    rng = random.Random(1)
    streams = []
    for _ in range(5):
        texts = sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 40)))
        shares = [0] + [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(texts, texts[1:])]
        streams.append((texts, shares[: len(texts)]))
    order, shares = suffix_dedup.merge(streams)
    heads = [iter(t) for t, _ in streams]
    merged = [next(heads[s]) for s in order]
    assert merged == sorted(t for texts, _ in streams for t in texts)
    assert shares[1:] == [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(merged, merged[1:])]


def test_run_of_is_the_same_in_tasks(spark):
    ids = [0, 1, 5, 10**12, -7, 2**63 - 1]
    found = spark.createDataFrame([(i,) for i in ids], "id long").select(runs.run_of(F.col("id"), 13).alias("r")).collect()
    import numpy as np

    assert [r.r for r in found] == runs.place_of(np.array(ids), 13).tolist()
