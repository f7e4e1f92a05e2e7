"""Ratios with an explicit undefined state, and the precision/recall/F1 columns built from integer counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDEFINED = "undefined_zero_denominator"


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null over zero."""
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def ratio_status(denominator: Column) -> Column:
    return F.when(denominator > 0, F.lit("defined")).otherwise(F.lit(UNDEFINED))


def zero_ratio(numerator: Column, denominator: Column) -> Column:
    """The other policy: 0.0 where the denominator is zero."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def triple_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to a frame with tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def binary_metrics(counts: DataFrame) -> DataFrame:
    """triple_metrics and accuracy, of a frame that also has tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return triple_metrics(counts).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
