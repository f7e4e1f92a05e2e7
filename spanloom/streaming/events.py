"""The journal as a stream: each query has a batch twin with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.scoring import read
from spanloom.sources.files import scratch


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pattern matches this one name; a plain path would have to be a folder
    found = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote; a full result replaces the one before."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/log")
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    else:
        writer = writer.format("parquet").option("path", f"{path}/rows")
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def event_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended once per candidate, type and minute; state older than the watermark is dropped."""
    events = _stream(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("minute", "1 day")
    once = drained(events.select("user_id", "event_type", "minute").dropDuplicates(["user_id", "event_type", "minute"]), "append")
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def telemetry_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and seconds per hour and status."""
    hours = _stream(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("seconds"))
    flat = hours.select(F.col("w.start").alias("hour"), "event_type", "n", "seconds")
    return drained(flat, "complete").select(F.unix_seconds("hour").alias("hour"), "event_type", "n", F.round("seconds", 4).alias("seconds"))


QUERIES = {"event_dedup_stream": event_dedup_stream, "telemetry_window_stream": telemetry_window_stream}

ORACLES = {
    "event_dedup_stream": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) FROM events) GROUP BY event_type",
    "telemetry_window_stream": "SELECT epoch(date_trunc('hour', ts))::bigint AS hour, event_type, count(*) AS n, round(sum(value), 4) AS seconds FROM events GROUP BY ALL",
}
