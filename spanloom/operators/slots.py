"""Bit maps of fixed size over hashed values: rows that cannot meet a set of values are left where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 25


def marked(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Adds `may`: whether the `key` may be one of `wanted`'s. Others are marked only if they share a slot.

    The map has SLOTS bits however many values there are, in SLOTS / 32,768 rows of 4 kB each, which every task may hold.
    """

    def slot() -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(SLOTS))

    bits = wanted.groupBy(F.bitmap_bucket_number(slot()).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("_bits"))
    at = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_part", F.bitmap_bucket_number(slot())).join(F.broadcast(bits), "_part", "left")
    return held.withColumn("may", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_part", "_bits")


def passing(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose `key` may be one of `wanted`'s, so a join by the key must follow."""
    return marked(rows, wanted, *key).where("may").drop("may")


def without(rows: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """The rows whose `key` is none of `gone`'s (a table, as it is read twice): only those that may be meet it in a join."""
    told = marked(rows, gone, *key)
    return told.where("NOT may").drop("may").unionByName(told.where("may").drop("may").join(gone, list(key), "left_anti"))
