import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup
from tests.llm import cases


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()


@pytest.mark.parametrize("share", [exact_dedup.HEAVY_SHARE, 2.0])  # all groups heavy; none
def test_odd_cases(spark, share):
    rows = cases.odd_rows()
    found = exact_dedup.groups(cases.frame(spark, rows), heavy_share=share).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[digest(r[1])].append(r[0])
    assert len(found) == len(rows)
    for d, ids in groups.items():
        mine = [r for r in found if bytes(r.digest) == d]
        keep = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in mine} == {keep} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [keep]


def test_drop_copies_keeps_columns(spark):
    rows = cases.odd_rows()
    df = cases.frame(spark, rows)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(digest(r.text) for r in left.collect()) == sorted({digest(r[1]) for r in rows})


def test_drop_copies_leaves_clashing_columns_alone(spark):
    rows = [(1, "a b", 7), (2, "a  b", 8), (2, "a b", 9), (None, "x", 1), (None, "x", 1), (3, None, 2), (3, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest long").withColumn("__id", F.lit(99)).withColumn("row", F.lit("r"))
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.digest, r.__getitem__("__id"), r.row) for r in left.select("*").collect()) == sorted([(0, "x", 1, 99, "r"), (1, "a b", 7, 99, "r"), (3, None, 2, 99, "r")], key=lambda r: r[0])


def test_empty_table(spark):
    assert exact_dedup.groups(cases.frame(spark, []).limit(0)).count() == 0


def test_misra_gries_never_misses_a_heavy_digest():
    import pyarrow as pa

    data = [b"hot"] * 400 + [str(i).encode() for i in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(data[i::7], pa.binary())], ["digest"]) for i in range(7)]
    (out,) = exact_dedup.misra_gries(10)(iter(batches))
    held = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    assert len(held) <= 10 and 400 - 1300 / 11 <= held[b"hot"] <= 400
