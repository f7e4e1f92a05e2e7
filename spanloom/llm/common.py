"""Shared folder handling and small column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words and lines everywhere in this subpackage.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 2**63 - 1  # stands for a null id: larger than all others


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Where it is unset, a folder of this machine, if it is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_tables: list[tuple[str, DataFrame]] = []  # path and frame of each table written and not dropped


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: `df` as a Parquet table of its own in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables.append((path, out))
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for path, frame in [t for t in _tables if any(t[1] is f for f in frames)]:
        removed(frame.sparkSession, path)
    _tables[:] = [t for t in _tables if not any(t[1] is f for f in frames)]


def mark() -> int:
    """How many tables there are now: what `dropped_since` goes by."""
    return len(_tables)


def dropped_since(begin: int, *kept: DataFrame) -> None:
    """Deletes the tables written since `mark` gave `begin`, but for some."""
    dropped(*[frame for _, frame in _tables[begin:] if not any(frame is k for k in kept)])


#: Rows that an Arrow batch holds at most: long texts in a batch are what a Python worker has to have room for.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by the key and the seed, the same in any engine that has md5."""
    digest = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
