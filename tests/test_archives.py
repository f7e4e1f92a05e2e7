"""Archives are read by slices, with unsafe names refused and exactly one match a suffix."""

import zipfile

import pyarrow as pa
import pytest

from spanloom.sources import archives


def test_slices_hold_every_member_once(spark, tmp_path):
    rows = [(f"a/{i}.txt", bytes([i % 251]) * (i * 7 % 900)) for i in range(200)] + [("b/0.bin", b"")]
    archives.write_archives(spark.createDataFrame(rows, "member string, content binary").repartition(3), str(tmp_path / "z"))
    assert len(list((tmp_path / "z").glob("*.zip"))) == 3
    for width in (64, 1 << 20):
        found = archives.members(spark, str(tmp_path / "z"), width)
        assert found.rdd.getNumPartitions() >= (3 if width > 64 else 20)
        assert sorted((r.member, bytes(r.content)) for r in found.collect()) == sorted(rows)
        assert [r.bytes for r in found.where("member = 'a/5.txt'").collect()] == [35]
        assert found.where("member LIKE '%.bin'").count() == 1


def test_archives_in_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    """Neither side opens the path by itself; archives of a few bytes each are whole, also with Python's reader of slices."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    rows = [(f"a/{i}.txt", bytes([i % 251, 10, 0, 13, 255]) * (i * 7 % 90)) for i in range(200)] + [("b/0.bin", b"")]
    archives.write_archives(spark.createDataFrame(rows, "member string, content binary").repartition(3), "viewfs://kept/in/z")
    found = archives.whole_members(spark, "viewfs://kept/in/z")
    assert sorted((r.member, bytes(r.content)) for r in found.collect()) == sorted(rows) and all(r.bytes == len(r.content) for r in found.collect())
    assert sorted((r.member, bytes(r.content)) for r in archives.members(spark, str(tmp_path / "z")).collect()) == sorted(rows)
    archives.write_archives(spark.createDataFrame([], "member string, content binary"), "viewfs://kept/in/none")
    assert archives.whole_members(spark, "viewfs://kept/in/none").count() == 0
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows]), pa.array([c for _, c in rows])], ["member", "content"])
    made = list(archives.zipped(iter([batch])))
    again = pa.RecordBatch.from_arrays([pa.array(["z"] * len(made)), pa.array([m.column(0)[0].as_py() + b"\n" for m in made])], ["path", "content"])
    told = [r for b in archives.unzipped(iter([again])) for r in b.to_pylist()]
    assert len(made) > 3 and [(r["member"], r["content"]) for r in told] == rows


def test_pushed_filters_give_the_same_rows(spark, tmp_path):
    rows = [(f"{i}.{e}", bytes([i])) for i in range(40) for e in ("txt", "csv")]
    archives.write_archives(spark.createDataFrame(rows, "member string, content binary").repartition(2), str(tmp_path / "z"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        found = archives.members(spark, str(tmp_path / "z")).where("member LIKE '%.csv' AND bytes > 0").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted((r.member, bytes(r.content)) for r in found) == sorted(r for r in rows if r[0].endswith("csv"))


def test_filters_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    reader = archives.FilteringZipReader({"path": "/nowhere"})
    rest = list(reader.pushFilters([StringEndsWith(("member",), ".txt"), GreaterThan(("bytes",), 3), EqualTo(("archive",), "x")]))
    assert reader.wanted == [("member", "endswith", ".txt"), ("archive", "equals", "x")] and rest == [GreaterThan(("bytes",), 3)]
    with pytest.raises(FileNotFoundError):
        reader.partitions()


@pytest.mark.parametrize("name", ["../a", "/a", "a\\b", "c:/a", "x/../../a"])
def test_unsafe_names(spark, tmp_path, name):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("fine", "x")
        archive.writestr(name, "x")
    with pytest.raises(Exception, match="unsafe member"):
        archives.members(spark, str(tmp_path / "a.zip")).collect()


def test_links_repeats_and_empty_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert archives.members(spark, str(tmp_path / "none")).count() == 0
    with zipfile.ZipFile(tmp_path / "link.zip", "w") as archive:
        link = zipfile.ZipInfo("a")
        link.external_attr = 0o120777 << 16
        archive.writestr(link, "/etc")
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "twice.zip", "w") as archive:
        archive.writestr("a", "x")
        archive.writestr("a", "y")
    for bad in ("link", "twice"):
        with pytest.raises(Exception, match="unsafe member"):
            archives.members(spark, str(tmp_path / f"{bad}.zip")).collect()


def test_located(spark):
    found = spark.createDataFrame([("z", "in/a.txt", 1, "s1"), ("z", "x/in/a.txt", 1, "s1"), ("z", "in/ba.txt", 2, "s2"), ("z", "c.txt", 3, "s3"), ("z", "d.txt", 4, "s4")], "archive string, member string, bytes long, sha256 string")
    wanted = spark.createDataFrame([("a.txt", 1, "s1"), ("x/in/a.txt", 1, "s1"), ("ba.txt", 9, "s2"), ("c.txt", 3, "other"), ("d.txt", 4, "s4"), ("e.txt", 1, "s")], "suffix string, bytes long, sha256 string")
    got = {r.suffix: (r.n_found, r.member, r.problem) for r in archives.located(found, wanted).collect()}
    assert got == {"a.txt": (2, None, "repeated"), "x/in/a.txt": (1, "x/in/a.txt", None), "ba.txt": (1, "in/ba.txt", "bytes"), "c.txt": (1, "c.txt", "sha256"), "d.txt": (1, "d.txt", None), "e.txt": (0, None, "missing")}
