"""Strict and lenient readers, write-once sinks, archives and inventories over Spark's file sources."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources import archives


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; of this machine only in local mode, where none is named."""
    shared, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not shared:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        shared = context.getCheckpointDir()
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The frame as a table of its own in the shared folder, for what several later steps read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._spanloom_path = path
    return found


def discarded(*frames: DataFrame) -> None:
    """Deletes saved tables that nothing will read again."""
    for frame in frames:
        spark = frame.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(frame._spanloom_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def strict_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Header names, their order, every row's arity and type must be as the schema says; anything else fails the scan."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("multiLine", True).option("sep", sep).option("escape", '"').csv(path)


def jsonl_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(value, row, problem) of every line: blank, not an object, with missing or extra fields, or null."""
    lines = spark.read.text(path)
    names = F.array(*[F.lit(f.name) for f in schema])
    keys = F.json_object_keys("value")
    problem = (
        F.when(F.trim("value") == "", "blank")
        .when(keys.isNull() | ~F.rtrim("value").endswith("}"), "not_an_object")
        .when(F.size(F.array_except(names, keys)) > 0, "missing_field")
        .when(F.size(F.array_except(keys, names)) > 0, "extra_field")
    )
    return lines.select("value", F.from_json("value", schema).alias("row"), problem.alias("problem"))


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows, failing on the first line with a problem."""
    checked = jsonl_lines(spark, path, schema)
    guard = F.when(F.col("problem").isNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.col("problem"), F.lit(": "), F.substring("value", 1, 80))))
    return checked.select(guard.alias("row")).select("row.*")


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("row")).select("row.*")


def write_once(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Writes the frame if nothing is there; else the saved rows must be the same multiset. True if it wrote."""
    spark = df.sparkSession
    try:
        saved = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)
        return True
    same = saved.select(*df.columns)
    if not df.exceptAll(same).isEmpty() or not same.exceptAll(df).isEmpty():
        raise ValueError(f"{path} holds other rows")
    return False


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, md5) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(archive, member, content) of the wanted members; unsafe or repeated names fail."""
    wanted = reduce(lambda a, b: a | b, [F.col("member").endswith(s) for s in suffixes])
    return archives.members(spark, path).where(wanted).select("archive", "member", "content")
