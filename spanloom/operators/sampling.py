"""The first rows of each group in the order of a hash, without ordering any group as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, by: list[str], h: str, quotas: DataFrame, quota: str = "quota", digits: int = 3) -> DataFrame:
    """Adds chosen: whether a row is one of its group's `quota` smallest by the hexadecimal hash `h`.

    Rows are counted by the hash's first digits, and prefix sums find the bin that holds a group's border: bins before it are
    chosen whole, those after it not, and only rows of that one bin are ordered. `quotas` has one row per group. Nulls in
    `by` are a group; a group without quota has none chosen.
    """
    bin_ = F.substring(h, 1, digits)
    counts = rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    reached = counts.withColumn("reached", F.sum("n").over(so_far)).alias("c").join(quotas.select(*by, F.col(quota).alias("quota")).alias("q"), same)
    border = reached.where("reached >= quota").groupBy(*[F.col(f"c.{c}").alias(f"of_{c}") for c in by]).agg(
        F.min(F.struct("bin", (F.col("quota") - F.col("reached") + F.col("n")).alias("left"))).alias("border"))
    small = quotas.select(*[F.col(c).alias(f"of_{c}") for c in by], F.lit(True).alias("known"))
    match = [F.col(f"s.of_{c}").eqNullSafe(F.col(f"b.of_{c}")) for c in by]
    plan = small.alias("s").join(border.alias("b"), match, "left").select("s.*", "border")
    placed = rows.withColumn("bin", bin_).join(plan, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], "left")
    inside = F.col("bin") == F.col("border.bin")
    clear = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("chosen", F.when(F.col("known"), F.coalesce(F.col("bin") < F.col("border.bin"), F.lit(True))).otherwise(False))
    order = Window.partitionBy(*by).orderBy(h)
    edge = placed.where(inside).withColumn("chosen", F.row_number().over(order) <= F.col("border.left"))
    return clear.unionByName(edge).select(*rows.columns, "chosen")
