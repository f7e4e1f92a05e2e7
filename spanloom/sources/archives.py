"""ZIP archives as a Spark data source: a table of members, read in slices, with names and identities checked."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringEndsWith, StringStartsWith

SLICE_BYTES = 32 << 20
ARCHIVE_BYTES = 16 << 20  # of a written archive, before its last member
BATCH_BYTES = 8 << 20
MEMBERS = "archive string, member string, bytes long, content binary"


def _opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def checked_members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The files of an archive; unsafe, linked or repeated names fail the scan."""
    seen, found = set(), []
    for info in archive.infolist():
        name = info.orig_filename
        inner = PurePosixPath(name)
        linked = (info.external_attr >> 16) & 0o170000 == 0o120000
        if not name or "\\" in name or "\0" in name or inner.is_absolute() or linked or name in seen or any(p == ".." or ":" in p for p in inner.parts):
            raise ValueError(f"unsafe member {name!r}")
        seen.add(name)
        if not info.is_dir():
            found.append(info)
    return found


class Slice(InputPartition):
    """The members of one archive whose bytes begin in one slice of it."""

    def __init__(self, path: str, nth: int, width: int, wanted: list[tuple[str, str, str]]):
        self.path, self.nth, self.width, self.wanted = path, nth, width, wanted


class ZipReader(DataSourceReader):
    """The driver lists names and sizes of archives alone; each task reads an archive's directory and its own slice's members."""

    def __init__(self, options):
        self.root = options["path"]
        self.width = int(options.get("sliceBytes", SLICE_BYTES))
        self.wanted: list[tuple[str, str, str]] = []

    def partitions(self):
        from pyarrow import fs

        system, root = _opened(self.root)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        inside = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.root[: len(self.root) - len(root)] if self.root.endswith(root) else ""
        archives = sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and f.path.endswith(".zip"))
        slices = [Slice(prefix + path, nth, self.width, self.wanted) for path, size in archives for nth in range(-(-size // self.width))]
        return slices or [Slice("", 0, self.width, self.wanted)]

    def read(self, partition) -> Iterator[tuple]:
        def fits(column: str, value: str) -> bool:
            return all(value == v if how == "equals" else getattr(value, how)(v) for c, how, v in partition.wanted if c == column)

        if not partition.path or not fits("archive", partition.path):
            return
        system, path = _opened(partition.path)
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
            for info in checked_members(archive):
                if info.header_offset // partition.width == partition.nth and fits("member", info.filename):
                    yield partition.path, info.filename, info.file_size, archive.read(info)


class FilteringZipReader(ZipReader):
    """Takes filters over; Spark refuses this one in sessions without the setting."""

    def pushFilters(self, filters):
        kinds = {EqualTo: "equals", StringEndsWith: "endswith", StringStartsWith: "startswith"}
        for f in filters:
            if type(f) in kinds and f.attribute in (("archive",), ("member",)):
                self.wanted.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f


class ZipMembers(DataSource):
    """format("zip_members"): path of an archive or of a folder of them; options sliceBytes and pushdown (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return (FilteringZipReader if self.options.get("pushdown") == "true" else ZipReader)(self.options)


def members(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(archive, member, bytes, content) of every file in the archives under the path.

    Filters on the ends or the whole of `archive` and `member` are applied before contents are read, where the session has
    spark.sql.python.filterPushdown.enabled.
    """
    spark.dataSource.register(ZipMembers)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("zip_members").option("sliceBytes", slice_bytes).option("pushdown", pushdown).load(path)


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (member, content): archives of about `ARCHIVE_BYTES`. Each has a line break as its comment, and lacks it."""
    held, archive = io.BytesIO(), None

    def closed() -> pa.RecordBatch:
        archive.comment = b"\n"
        archive.close()
        return pa.RecordBatch.from_arrays([pa.array([held.getvalue()[:-1]], pa.binary())], ["archive"])

    for batch in batches:
        for member, content in zip(batch.column(0), batch.column(1), strict=True):
            if archive is None:
                held = io.BytesIO()
                archive = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)
            archive.writestr(zipfile.ZipInfo(member.as_py()), content.as_py(), zipfile.ZIP_DEFLATED)
            if held.tell() > ARCHIVE_BYTES:
                yield closed()
                archive = None
    if archive is not None:
        yield closed()


def write_archives(rows: DataFrame, path: str) -> None:
    """Archives of `rows` (member string, content binary) under the path, some to a partition; a task tried again leaves no second one.

    Spark's text writer puts each archive into a file of its own, wherever Spark can write; the line break that it adds is the
    archive's comment. The driver only names the files.
    """
    spark = rows.sparkSession
    made = rows.select("member", "content").mapInArrow(zipped, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(f"{path}/_made")
    at = spark._jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in system.listStatus(at(f"{path}/_made")))
    for nth, name in enumerate(n for n in names if n.startswith("part-")):
        if not system.rename(at(f"{path}/_made/{name}"), at(f"{path}/part-{nth:05d}.zip")):
            raise OSError(f"{path}/_made/{name} could not be renamed")
    system.delete(at(f"{path}/_made"), True)


def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (archive, content of the file): the members, as `members` gives them, some megabytes at a time."""
    names = ["archive", "member", "bytes", "content"]
    for batch in batches:
        for path, body in zip(batch.column(0), batch.column(1), strict=True):
            with zipfile.ZipFile(io.BytesIO(body.as_py())) as archive:
                rows, size = [], 0
                for info in checked_members(archive):
                    rows.append((path.as_py(), info.filename, info.file_size, archive.read(info)))
                    size += info.file_size
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)


def whole_members(spark: SparkSession, path: str) -> DataFrame:
    """`members` of archives small enough for a task to hold, as `write_archives` makes them, wherever Spark can read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return found.select("path", "content").mapInArrow(unzipped, MEMBERS)


def identities(found: DataFrame) -> DataFrame:
    """(archive, member, bytes, md5, sha256) of members."""
    return found.select("archive", "member", "bytes", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def located(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(suffix, n_found, member, problem) of each `wanted` (suffix, bytes, sha256) among `found` identities.

    A member matches a suffix that equals its last path parts: members give all their endings, so this is an equi-join.
    Exactly one must match (`missing`, `repeated`), with the bytes and digest asked for (`bytes`, `sha256`).
    """
    parts = F.split("member", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ended = found.select(F.explode(endings).alias("suffix"), F.struct("member", "bytes", "sha256").alias("x"))
    met = wanted.join(ended, "suffix", "left").groupBy("suffix").agg(
        F.count("x").alias("n_found"), F.min("x").alias("x"), F.first(wanted["bytes"]).alias("bytes"), F.first(wanted["sha256"]).alias("sha256"))
    problem = (
        F.when(F.col("n_found") == 0, "missing").when(F.col("n_found") > 1, "repeated")
        .when(~F.col("x.bytes").eqNullSafe(F.col("bytes")), "bytes").when(~F.col("x.sha256").eqNullSafe(F.col("sha256")), "sha256")
    )
    return met.select("suffix", "n_found", F.when(F.col("n_found") == 1, F.col("x.member")).alias("member"), problem.alias("problem"))
