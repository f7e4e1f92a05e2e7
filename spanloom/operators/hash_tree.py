"""Hash trees over whole tables: leaves cut by key ranges and levels up to one root; and the differences of two tables.

Rows are ordered by (key, hash of the row) over range partitions; prefix sums of the partitions' counts give each its ordinal, and
a leaf is `leaf` ordinals. Equal rows are one entry with its number, so no leaf is longer, whatever repeats.

Two tables are compared by slots of hashed keys. A slot holds two sums of row hashes, of one table less those of the other, so rows
themselves are neither stored nor sorted for it; a slot whose sums are not zero, or too large for a number, differs. Both tables are
read again, and rows in slots that differ are counted one by one. Slots that differ are broadcast as a bit map, of 4 MB at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.files import saved

LEAF = 1024
FANOUT = 64
SLOTS = 1 << 25


@dataclass
class Leaves:
    """entries (key, h, n, leaf) of a table."""

    entries: DataFrame


def entries_of(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, h, n): distinct rows by the hash of their other columns, and how often each is there."""
    rest = [c for c in df.columns if c not in key]
    h = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256) if rest else F.lit("")
    return df.select(F.struct(*key).alias("key"), h.alias("h")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))


def ranged(df: DataFrame) -> DataFrame:
    """The rows with `part`, the number of their range of (key, h), as a table."""
    return saved(df.repartitionByRange("key", "h").withColumn("part", F.spark_partition_id()))


def leaves(df: DataFrame, key: list[str], leaf: int = LEAF) -> Leaves:
    """The entries of a table, `leaf` to a leaf."""
    parted = ranged(entries_of(df, key))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = parted.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("key", "h")
    ordinal = F.col("before") + F.row_number().over(within) - 1
    held = saved(parted.join(F.broadcast(before), "part").withColumn("ordinal", ordinal).select("key", "h", "n", F.floor(F.col("ordinal") / leaf).alias("leaf")))
    return Leaves(held)


def digests(held: Leaves, most: int = LEAF) -> DataFrame:
    """(leaf, size, digest): digest is null where a leaf has more than `most` entries, which then differs from all that have not."""
    sizes = held.entries.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    short = held.entries.join(sizes.where(F.col("size") <= most), "leaf")
    row = F.struct("key", "h", "n")
    text = F.to_json(F.array_sort(F.collect_list(row)))
    return sizes.join(short.groupBy("leaf").agg(F.sha2(text, 256).alias("digest")), "leaf", "left")


def levels(leaf_digests: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """(node, digest) of each level, leaves first, until a level has one node: the root."""
    level = saved(leaf_digests.select(F.col("leaf").alias("node"), F.concat_ws(":", "size", F.coalesce("digest", F.lit("long"))).alias("digest")))
    out = [level]
    while not level.where("node > 0").isEmpty():
        child = F.struct("node", "digest")
        up = level.select(F.floor(F.col("node") / fanout).alias("up"), F.struct("node", "digest").alias("child"))
        level = saved(up.groupBy(F.col("up").alias("node")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list("child"))), 256).alias("digest")))
        out.append(level)
    return out


def root(df: DataFrame, key: list[str], leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(n, digest): rows of a table and the hash of its tree; the same however the rows are dealt."""
    held = leaves(df, key, leaf)
    top = levels(digests(held, leaf), fanout)[-1]
    return held.entries.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(top.agg(F.coalesce(F.max("digest"), F.lit("")).alias("digest")))  # one row each


def slotted(df: DataFrame, key: list[str], slots: int) -> DataFrame:
    """(key, h, slot) of each row: the hash of its other columns, and the slot of its key."""
    rest = [c for c in df.columns if c not in key]
    h = F.unhex(F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)) if rest else F.lit(b"")
    return df.select(F.struct(*key).alias("key"), h.alias("h"), F.pmod(F.xxhash64(*key), F.lit(slots)).alias("slot"))


def differing(before: DataFrame, after: DataFrame, word: int) -> DataFrame:
    """(word, bits): the slots of two slotted tables whose rows differ, as bits of words that have any."""
    both = None
    for rows, sign in ((before, 1), (after, -1)):
        body = F.sha2(F.to_json(F.struct("key", F.hex("h").alias("h")), {"ignoreNullFields": "false"}), 256)
        parts = [(F.conv(F.substring(body, at, 12), 16, 10).cast("long") * sign).alias(name) for at, name in ((1, "x"), (13, "y"))]
        side = rows.select("slot", *parts)
        both = side if both is None else both.unionByName(side)
    sums = both.groupBy("slot").agg(F.try_sum("x").alias("x"), F.try_sum("y").alias("y"))
    unequal = sums.where(F.coalesce((F.col("x") != 0) | (F.col("y") != 0), F.lit(True)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(word)).cast("int"))
    return unequal.groupBy(F.floor(F.col("slot") / word).alias("word")).agg(F.bit_or(bit).alias("bits"))


def differences(before: DataFrame, after: DataFrame, key: list[str], slots: int = SLOTS, word: int = 64) -> DataFrame:
    """(key columns, change, n_before, n_after): keys whose rows are missing, added or changed in `after`. Columns go by name."""
    a, b = slotted(before, key, slots), slotted(after.select(*before.columns), key, slots)
    map_of = F.broadcast(saved(differing(a, b, word)))
    told = None
    for rows, n in ((a, (1, 0)), (b, (0, 1))):
        met = rows.withColumn("word", F.floor(F.col("slot") / word)).join(map_of, "word").where(F.getbit("bits", F.pmod("slot", F.lit(word)).cast("int")) == 1)
        side = met.select("key", "h", *[F.lit(x).cast("long").alias(name) for x, name in zip(n, ("n_before", "n_after"), strict=True)])
        told = side if told is None else told.unionByName(side)
    both = told.groupBy("key", "h").agg(*[F.sum(n).alias(n) for n in ("n_before", "n_after")]).where("n_before <> n_after")
    sums = both.groupBy("key").agg(*[F.sum(n).alias(n) for n in ("n_before", "n_after")])
    change = F.when(F.col("n_after") == 0, "missing").when(F.col("n_before") == 0, "added").otherwise("changed")
    return sums.select("key.*", change.alias("change"), "n_before", "n_after")
