"""Walks over values of unknown shape: a level of objects and lists is opened at a time, until only scalars are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.files import saved

NESTED = "^(OBJECT|ARRAY)"


def walk(df: DataFrame, key: str, column: str, most: int = 1_000) -> DataFrame:
    """(key, path, name, value) of every scalar below a variant column, empty objects and lists included: path as $.a[0].b, name
    the last field on it, value as a string (null for null and for what is empty).

    No schema is given or made out: a level is one join with what its values hold, so there are as many rounds as levels, and
    a round's rows are the values at that depth. A value that is nested more than `most` levels deep is refused.
    """
    level = df.select(F.col(key), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col(column).alias("v")).where("v IS NOT NULL")
    told = []
    for _ in range(most):
        level = saved(level.withColumn("kind", F.schema_of_variant("v")))
        inner = level.where(F.col("kind").rlike(NESTED))
        told.append(level.where(F.col("kind").isNull() | ~F.col("kind").rlike(NESTED)))
        if inner.isEmpty():
            break
        # what is empty opens to one row without a place, which tells it
        opened = inner.alias("t").lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).alias("x"))
        # a field's name is quoted where a dot or bracket in it would make another path
        plain = F.col("x.key").rlike("^[A-Za-z0-9_]+$")
        step = F.when(F.col("x.pos").isNull(), "").when(F.col("x.key").isNull(), F.concat(F.lit("["), F.col("x.pos").cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("."), F.col("x.key"))).otherwise(F.concat(F.lit('."'), F.col("x.key"), F.lit('"')))
        level = opened.select(F.col(f"t.{key}"), F.concat("t.path", step).alias("path"), F.coalesce("x.key", "t.name").alias("name"), F.col("x.value").alias("v"))
    else:
        raise ValueError(f"a value is nested more than {most} levels deep")
    rows = told[0]
    for part in told[1:]:
        rows = rows.unionByName(part)
    return rows.select(key, "path", "name", F.try_variant_get("v", "$", "string").alias("value"))


def foreign(df: DataFrame, key: str, column: str, own: str, field: str = "run_id") -> DataFrame:
    """(key, path, value): every scalar under a field of that name, however deep, that is not the row's `own`."""
    found = walk(df, key, column).where(F.col("name") == field)
    return found.join(df.select(key, F.col(own).alias("own")), key).where(~F.col("value").eqNullSafe(F.col("own"))).select(key, "path", "value")
