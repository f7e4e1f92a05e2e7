"""Pools over ranges of token states in constant time a range: maxima of doubling widths and running sums, from one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels_for(longest: int) -> int:
    return max(longest, 1).bit_length()


def ranges(states: DataFrame, dim: int, longest: int) -> DataFrame:
    """(sentence, at, state, most, before) of the finite `states` (sentence, at, state of `dim` numbers), `at` running 0, 1, 2, ...

    most[k] is the element-wise maximum of the 2^k states from `at` on (null where the sentence ends before), up to the
    largest power of two within `longest`; `before` is the sum of all states before `at`. All windows share one order, so the
    rows are shuffled and sorted once, and no task holds more of a sentence than the window's frame.
    """
    order = Window.partitionBy("sentence").orderBy("at")
    held = states.select("sentence", "at", F.col("state").cast("array<double>").alias("state")).withColumn("most0", F.col("state"))
    for k in range(1, levels_for(longest)):
        half = F.lead(f"most{k - 1}", 1 << (k - 1)).over(order)
        held = held.withColumn("half", half).withColumn(f"most{k}", F.zip_with(f"most{k - 1}", "half", lambda a, b: F.greatest(a, b))).drop("half")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*[F.coalesce(F.sum(F.get("state", F.lit(i))).over(earlier), F.lit(0.0)) for i in range(dim)])
    return held.select("sentence", "at", "state", F.array(*[f"most{k}" for k in range(levels_for(longest))]).alias("most"), before.alias("before"))


def span_states(held: DataFrame, spans: DataFrame) -> DataFrame:
    """(sentence, start, end, state) of the inclusive `spans` (sentence, start, end): first, last and greatest states in one array.

    A span asks for two or three rows of `ranges`, whatever its length. Spans that leave the sentence, end before they start
    or are longer than `ranges` was built for have no row.
    """
    width = F.col("end") - F.col("start") + 1
    level = F.length(F.bin(width)) - 1  # of the largest power of two within the width
    sized = spans.where(width >= 1).select("sentence", "start", "end", level.alias("level")).distinct()
    second = F.col("end") - F.pow(F.lit(2), F.col("level")).cast("long") + 1
    asked = sized.select("*", F.explode(F.array(*[F.struct(F.lit(role).alias("role"), at.cast("long").alias("at")) for role, at in (("first", F.col("start")), ("second", second), ("last", F.col("end")))])).alias("x"))
    met = asked.select("sentence", "start", "end", "level", "x.role", "x.at").join(held.select("sentence", F.col("at").cast("long").alias("at"), "state", "most"), ["sentence", "at"])

    def of(role: str, value: Column) -> Column:
        return F.first(F.when(F.col("role") == role, value), ignorenulls=True)

    reach = F.get("most", F.col("level"))
    pooled = met.groupBy("sentence", "start", "end").agg(of("first", F.col("state")).alias("first"), of("last", F.col("state")).alias("last"), of("first", reach).alias("a"), of("second", reach).alias("b"))
    most = F.zip_with("a", "b", lambda a, b: F.greatest(a, b))
    return pooled.select("sentence", "start", "end", F.concat("first", "last", most).alias("state")).where("state IS NOT NULL")


def between_states(held: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """`pairs` (sentence, s1, e1, s2, e2) with the mean of the states strictly between both spans; zeros where there are none."""
    low, high = F.least("e1", "e2") + 1, F.greatest("s1", "s2")  # high is exclusive
    sized = pairs.select("sentence", "s1", "e1", "s2", "e2", low.cast("long").alias("low"), high.cast("long").alias("high"))
    sums = held.select("sentence", F.col("at").cast("long").alias("at"), "before")
    apart = sized.where("low < high")
    upper = apart.join(sums.select("sentence", F.col("at").alias("high"), F.col("before").alias("upto")), ["sentence", "high"])
    both = upper.join(sums.select("sentence", F.col("at").alias("low"), "before"), ["sentence", "low"])
    mean = F.zip_with("upto", "before", lambda a, b: (a - b) / (F.col("high") - F.col("low")))
    zeros = F.array_repeat(F.lit(0.0), dim)
    key = ["sentence", "s1", "e1", "s2", "e2"]
    return both.select(*key, mean.alias("state")).unionByName(sized.where("low >= high").select(*key, zeros.alias("state")))
