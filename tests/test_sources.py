"""Strict scans fail closed; sinks write once."""

import zipfile

import pytest
from pyspark.sql import types as T

from spanloom.sources import files

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_csv(spark, tmp_path):
    good = put(tmp_path / "a.csv", 'id,name\n1,"x, ""y"""\n2,"two\nlines"\n')
    assert [tuple(r) for r in files.strict_csv(spark, good, SCHEMA).collect()] == [(1, 'x, "y"'), (2, "two\nlines")]
    for i, bad in enumerate(("name,id\nx,1\n", "id,name\n1,x,extra\n", "id,name\nx,y\n")):
        with pytest.raises(Exception):
            files.strict_csv(spark, put(tmp_path / f"bad{i}.csv", bad), SCHEMA).collect()


def test_jsonl(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", '{"id": 1, "name": "x"}\n{"name": null, "id": 2}\n')
    assert sorted(tuple(r) for r in files.strict_jsonl(spark, good, SCHEMA).collect()) == [(1, "x"), (2, None)]
    lines = put(tmp_path / "b.jsonl", '{"id": 1, "name": "x"}\n\n[1]\n{"id": 2}\n{"id": 3, "name": "y", "more": 1}\n')
    assert [r.problem for r in files.jsonl_lines(spark, lines, SCHEMA).collect()] == [None, "blank", "not_an_object", "missing_field", "extra_field"]
    with pytest.raises(Exception):
        files.strict_jsonl(spark, lines, SCHEMA).collect()
    assert files.lenient_jsonl(spark, put(tmp_path / "c.jsonl", '{"id": 1, "name": "x"}\n\n'), SCHEMA).count() == 1


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], SCHEMA)
    assert files.write_once(df, str(tmp_path / "t"), ["id"]) is True
    assert files.write_once(df.repartition(3), str(tmp_path / "t"), ["id"]) is False
    with pytest.raises(ValueError):
        files.write_once(df.distinct(), str(tmp_path / "t"), ["id"])


def test_zip_and_inventory(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("in/a.csv", "x")
        archive.writestr("in/b.txt", "y")
    assert [(r.member, bytes(r.content)) for r in files.zip_members(spark, str(tmp_path / "a.zip"), (".csv",)).collect()] == [("in/a.csv", b"x")]
    assert files.inventory(spark, str(tmp_path)).count() == 1
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as archive:
        archive.writestr("../a.csv", "x")
    with pytest.raises(Exception):
        files.zip_members(spark, str(tmp_path / "bad.zip"), (".csv",)).collect()
