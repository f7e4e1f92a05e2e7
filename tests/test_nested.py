"""Walks over variants against json.loads."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import nested


def plain(value, path="$", name=None):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            step = f".{k}" if k.isidentifier() and k.isascii() else f'."{k}"'
            yield from plain(v, path + step, k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain(v, f"{path}[{i}]", name)
    else:
        yield path, name, None if value is None or isinstance(value, (dict, list)) else str(value).lower() if isinstance(value, bool) else str(value)


TEXTS = [
    '{"a":{"b":[1,{"c":null,"d e":"x"},[[]]]},"run_id":"r1","t":true,"e":{}}', "[]", "7", "null", '"s"', '{"":{"run_id":["r2",{"run_id":"r1"}]}}', '{"x.y":[{"run_id":null}],"é":{"z":"a"}}',
    "[" * 60 + '{"run_id":"deep"}' + "]" * 60,
]


def test_every_scalar_of_any_shape(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, t string").withColumn("v", F.parse_json("t"))
    found = sorted((r.id, r.path, r.name or "", r.value or "") for r in nested.walk(df, "id", "v").collect())
    assert found == sorted((i, p, n or "", v or "") for i, t in enumerate(TEXTS) for p, n, v in plain(json.loads(t)))


def test_foreign_runs(spark):
    df = spark.createDataFrame([(i, t, "r1") for i, t in enumerate(TEXTS)], "id int, t string, own string").withColumn("v", F.parse_json("t"))
    found = {(r.id, r.path, r.value) for r in nested.foreign(df, "id", "v", "own").collect()}
    assert found == {(5, '$."".run_id[0]', "r2"), (6, '$."x.y"[0].run_id', None), (7, "$" + "[0]" * 60 + ".run_id", "deep")}
    with pytest.raises(ValueError):
        nested.walk(df, "id", "v", 20)
