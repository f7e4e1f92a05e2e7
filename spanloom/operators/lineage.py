"""Transitive closure over parent links, whatever their depth, and what is told of all ancestors without listing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.files import discarded, saved


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(child, ancestor, depth) of every ancestor, at its least distance, from (child, parent): all pairs, for those who need them.

    Paths double each round: what lies up to 2**k links away joined with itself gives all up to 2**(k + 1), so a chain of n
    links takes log2(n) rounds. Each round is a written table; the end is a round that adds nothing.
    """
    walk = saved(edges.where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    size = walk.count()
    for _ in range(most):
        on = walk.select(F.col("child").alias("via"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = walk.join(on, F.col("ancestor") == F.col("via")).where("child <> further").select("child", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        following = saved(walk.unionByName(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        discarded(walk)
        walk = following
        before, size = size, walk.count()
        if size == before:
            return walk
    raise RuntimeError(f"the closure did not settle in {most} rounds")


def totals(links: DataFrame, most: int = 64) -> DataFrame:
    """(child, n_ancestors, n_broken, oldest) from (child, parent, broken), where a child has one parent at most.

    Pointer jumping: each child's pointer carries what lies between the two, and takes on what the place that it points to
    carries. A round has one row a child, and a chain of n links takes log2(n) rounds; no pair of child and ancestor is formed.
    """
    walk = saved(links.where("parent IS NOT NULL").select("child", F.col("parent").alias("at"), F.lit(1).cast("long").alias("n"), F.col("broken").cast("long").alias("b"), F.col("parent").alias("oldest"), F.lit(True).alias("open")))
    for _ in range(most):
        on = walk.select(F.col("child").alias("at"), F.col("at").alias("next"), F.col("n").alias("n2"), F.col("b").alias("b2"), F.col("oldest").alias("oldest2"), F.lit(True).alias("met"))
        moved = walk.join(on, "at", "left")
        more = F.col("met").isNotNull()
        following = saved(moved.select(
            "child", F.when(more, F.col("next")).otherwise(F.col("at")).alias("at"), (F.col("n") + F.when(more, F.col("n2")).otherwise(0)).alias("n"),
            (F.col("b") + F.when(more, F.col("b2")).otherwise(0)).alias("b"), F.when(more, F.least("oldest", "oldest2")).otherwise(F.col("oldest")).alias("oldest"), more.alias("open"),
        ))
        discarded(walk)
        walk = following
        if walk.where("open").isEmpty():
            return walk.select("child", F.col("n").alias("n_ancestors"), F.col("b").alias("n_broken"), "oldest")
    raise RuntimeError(f"the links have a circle, or more than 2**{most} generations")


def judged(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, generation, n_broken, valid, oldest) of all `ids`, from (child, parent, broken): artifacts with any number of parents.

    Level by level from the artifacts without parents: an artifact is told when all its parents are. A level's rows are the
    links into it, so all levels together are the links. generation: the most links that lead up to an artifact without
    parents; n_broken: its own broken links; valid: neither its own links nor any above are broken; oldest: the least id among
    itself and what it descends from. A parent that is not among the ids is told when its child is asked for, and is a broken link.
    """
    links = saved(links.where("parent IS NOT NULL").distinct())
    named = saved(ids.select("id").distinct().join(links.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("wants"), F.count_if("broken").alias("n_broken")), "id", "left"))
    known = links.join(named.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    roots = named.where("wants IS NULL").select("id", F.lit(0).alias("generation"), F.lit(0).cast("long").alias("n_broken"), F.lit(True).alias("valid"), F.col("id").alias("oldest"))
    # links whose parent nobody told of come with the first level
    level = saved(roots.withColumn("fresh", F.lit(True)))
    absent = known.where("there IS NULL").select("child", F.lit(-1).alias("generation"), F.lit(False).alias("valid"), F.col("child").alias("oldest"))
    waiting = saved(absent)
    told = [level.drop("fresh")]
    while True:
        met = links.join(level.select(F.col("id").alias("parent"), "generation", "valid", "oldest"), "parent").select("child", "generation", (F.col("valid") & ~F.col("broken")).alias("valid"), "oldest")
        heard = waiting.unionByName(met)
        # a child is told once it has heard of all its links; what it has heard so far waits
        full = named.where("wants IS NOT NULL").select(F.col("id").alias("child"), "wants", "n_broken")
        sums = heard.groupBy("child").agg(F.count(F.lit(1)).alias("got"), F.max("generation").alias("generation"), F.min("valid").alias("valid"), F.min("oldest").alias("oldest")).join(full, "child")
        done = sums.where("got = wants").select(F.col("child").alias("id"), (F.col("generation") + 1).alias("generation"), "n_broken", (F.col("valid") & (F.col("n_broken") == 0)).alias("valid"), F.least("oldest", "child").alias("oldest"))
        following = saved(done)
        if following.isEmpty():
            break
        told.append(following)
        before, waiting = waiting, saved(heard.join(following.select(F.col("id").alias("child")), "child", "left_anti"))
        discarded(before)
        level = following
    out = told[0]
    for part in told[1:]:
        out = out.unionByName(part)
    return out


def recorded(artifacts: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent, broken): `parents` (child, parent, parent_sha256) against `artifacts` (id, sha256); a link is broken where
    the parent is absent or its hash is not the one recorded."""
    own = artifacts.select(F.col("id").alias("parent"), F.col("sha256").alias("now"))
    return parents.join(own, "parent", "left").select("child", "parent", (~F.col("now").eqNullSafe(F.col("parent_sha256"))).alias("broken"))


def validated(artifacts: DataFrame) -> DataFrame:
    """(id, n_ancestors, n_broken, valid): artifacts with (id, sha256, parent, parent_sha256), one parent each; an artifact is
    valid if no link from it upwards is broken."""
    links = recorded(artifacts, artifacts.where("parent IS NOT NULL").select(F.col("id").alias("child"), "parent", "parent_sha256"))
    sums = totals(links).withColumnRenamed("child", "id")
    both = artifacts.select("id").join(sums, "id", "left").select("id", F.coalesce("n_ancestors", F.lit(0)).alias("n_ancestors"), F.coalesce("n_broken", F.lit(0)).alias("n_broken"))
    return both.withColumn("valid", F.col("n_broken") == 0)
