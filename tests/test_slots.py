"""Bit maps let through what may meet, and little else."""

from spanloom.operators import slots


def test_all_that_meets_passes_and_little_else(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    wanted = rows.where("k % 50 = 3").union(rows.where("k = 3")).union(spark.createDataFrame([(None,), (-7,)], "k long"))
    passed = slots.passing(rows, wanted, "k")
    assert passed.columns == ["k"] and 400 <= passed.count() < 420
    assert passed.where("k % 50 = 3").count() == 400
    assert slots.passing(rows, wanted.limit(0), "k").count() == 0


def test_rows_without_those_that_go(spark):
    rows = spark.createDataFrame([(i % 500, i, None if i % 7 == 0 else "x") for i in range(2000)], "k long, n long, t string")
    gone = rows.where("k % 25 = 3").select("k").distinct()
    left = slots.without(rows, gone, "k")
    assert sorted(r.n for r in left.collect()) == [i for i in range(2000) if i % 500 % 25 != 3] and left.columns == rows.columns
    assert slots.marked(rows, gone, "k").where("may").count() < 100
    assert slots.without(rows, gone.limit(0), "k").count() == 2000
