"""Exact paired statistics over small families of differences, as array expressions and windows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.files import saved

#: Documents that a task resamples at once, and replicates that it holds at once.
BLOCK_DOCS, BLOCK_REPLICATES = 4096, 500


def average_ranks(deltas: DataFrame, by: list[str], delta: str = "delta") -> DataFrame:
    """Adds twice the average rank of |delta| among the group's nonzero differences (an integer), as rank2; zeros drop."""
    kept = deltas.where(F.col(delta) != 0).withColumn("size", F.abs(delta))
    ordered, tied = Window.partitionBy(*by).orderBy("size"), Window.partitionBy(*by, "size")
    return kept.withColumn("rank2", 2 * F.rank().over(ordered) + F.count(F.lit(1)).over(tied) - 1)


def wilcoxon(deltas: DataFrame, by: list[str], delta: str = "delta") -> DataFrame:
    """Exact two-sided signed-rank test per group: n_nonzero, w_plus, w_minus, p_value. A group of zeros alone has p = 1.

    Ranks are doubled so that sums are integers. How likely each sum of positive ranks is comes from one pass over the ranks
    (each doubles the sign patterns), so a group costs its ranks times their sum and not two to the power of its size.
    """
    size = F.abs(delta)
    ordered, tied, whole = Window.partitionBy(*by).orderBy(size), Window.partitionBy(*by, size), Window.partitionBy(*by)
    zeros = F.count_if(F.col(delta) == 0).over(whole)  # the first in the order
    rank2 = F.when(F.col(delta) != 0, 2 * (F.rank().over(ordered) - zeros) + F.count(F.lit(1)).over(tied) - 1)
    ranked = deltas.where(F.col(delta).isNotNull()).withColumn("rank2", rank2)
    none = F.lit(0).cast("long")
    groups = ranked.groupBy(*by).agg(
        F.collect_list("rank2").alias("ranks"),
        F.coalesce(F.sum(F.when(F.col(delta) > 0, F.col("rank2"))), none).alias("plus"),
        F.coalesce(F.sum(F.when(F.col(delta) < 0, F.col("rank2"))), none).alias("minus"),
    )
    total, least = F.col("plus") + F.col("minus"), F.least("plus", "minus")

    def with_rank(chances: Column, rank: Column) -> Column:
        return F.transform(chances, lambda p, s: (p + F.coalesce(F.when(s >= rank, F.get(chances, (s - rank).cast("int"))), F.lit(0.0))) / 2)

    start = F.transform(F.sequence(none, total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    groups = groups.withColumn("chances", F.aggregate("ranks", start, with_rank))
    extreme = F.transform("chances", lambda p, s: F.when(F.least(s, total - s) <= least, p).otherwise(0.0))
    return groups.select(
        *by,
        F.size("ranks").cast("long").alias("n_nonzero"),
        (F.col("plus") / 2).alias("w_plus"),
        (F.col("minus") / 2).alias("w_minus"),
        F.aggregate(extreme, F.lit(0.0), lambda acc, p: acc + p).alias("p_value"),
    )


def holm(tests: DataFrame, label: str, p: str = "p_value") -> DataFrame:
    """Adds holm_p: the running maximum of min(1, (m - i) p) over ascending p, ties by label."""
    order, everything = Window.orderBy(p, label), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(everything) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("step", step).withColumn("holm_p", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def paired_t(deltas: DataFrame, by: list[str], delta: str = "delta") -> DataFrame:
    """n, df, mean, sd and t per group; t is null, with a status, where the differences do not vary."""
    mean, sd, n = F.avg(delta), F.stddev_samp(delta), F.count(delta)
    summed = deltas.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), sd.alias("sd"))
    status = F.when(F.col("n") < 2, "too_few").when(F.col("sd") == 0, F.when(F.col("mean") == 0, "all_zero").otherwise("zero_variance")).otherwise("defined")
    t = F.when(status == "defined", F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return summed.select(*by, "n", (F.col("n") - 1).alias("df"), "mean", "sd", t.alias("t"), status.alias("status"))


def resampled_documents(counts: DataFrame, replicates: int, seed: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(condition, seed, replicate, tp, fp, fn): counts over documents drawn with replacement, as many as there are.

    Documents stay where they are: a hash deals them to blocks, a replicate's generator splits its draws among the blocks by
    their sizes, and each block deals its own draws to its documents. All cells of a document share a draw.
    """
    docs = counts.select("doc").distinct()
    n_blocks = max(1, -(-docs.count() // block_docs))
    block = F.pmod(F.xxhash64("doc"), F.lit(n_blocks)).cast("int")
    sizes = np.zeros(n_blocks, np.int64)
    for row in docs.groupBy(block.alias("block")).count().collect():  # one number per block of documents
        sizes[row.block] = row["count"]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["block"].iloc[0])
        doc, ids = pd.factorize(pdf["doc"], sort=True)
        cell, cells = pd.factorize(pd.MultiIndex.from_frame(pdf[["condition", "seed"]]), sort=True)
        values = np.zeros((len(ids), len(cells), 3))
        np.add.at(values, (doc, cell), pdf[["tp", "fp", "fn"]].to_numpy(float))
        parts = []
        for first in range(0, replicates, BLOCK_REPLICATES):
            numbers = np.arange(first, min(replicates, first + BLOCK_REPLICATES))
            times = np.zeros((len(numbers), len(ids)))
            for i, r in enumerate(numbers.tolist()):
                mine = np.random.Generator(np.random.PCG64([seed, r])).multinomial(sizes.sum(), sizes / sizes.sum())[at]
                times[i] = np.random.Generator(np.random.PCG64([seed, r, at])).multinomial(mine, np.full(len(ids), 1 / len(ids)))
            sums = (times @ values.reshape(len(ids), -1)).reshape(len(numbers), len(cells), 3).round().astype(np.int64)
            parts.append(pd.DataFrame({
                "condition": np.tile(cells.get_level_values(0), len(numbers)), "seed": np.tile(cells.get_level_values(1), len(numbers)),
                "replicate": np.repeat(numbers, len(cells)), "tp": sums[..., 0].ravel(), "fp": sums[..., 1].ravel(), "fn": sums[..., 2].ravel()}))
        return pd.concat(parts)

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    schema = f"condition {kinds['condition']}, seed {kinds['seed']}, replicate long, tp long, fp long, fn long"
    drawn = counts.withColumn("block", block).groupBy("block").applyInPandas(draw, schema)
    return drawn if n_blocks == 1 else drawn.groupBy("condition", "seed", "replicate").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def hierarchical_bootstrap(counts: DataFrame, reference: str, replicates: int, seed: int, undefined_limit: float = 0.05, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Percentile intervals of micro-F1 under joint resampling of seeds and document clusters, and of the difference to a reference.

    `counts` has condition, seed, doc, tp, fp, fn: an aggregate with one row per cell. Every condition sees the same draws.
    """
    spark = counts.sparkSession
    seeds = [r.seed for r in counts.select("seed").distinct().orderBy("seed").collect()]  # the training seeds, a handful

    def seeds_drawn(batches):
        for batch in batches:
            for r in batch["id"].tolist():
                of_seed = np.random.Generator(np.random.PCG64([seed, r, 2**40])).multinomial(len(seeds), np.full(len(seeds), 1 / len(seeds)))
                yield pd.DataFrame({"replicate": r, "seed": seeds, "n_seed": of_seed}).query("n_seed > 0")

    of_seed = spark.range(replicates).mapInPandas(seeds_drawn, f"replicate long, seed {counts.schema['seed'].dataType.simpleString()}, n_seed long")
    sums = resampled_documents(counts, replicates, seed, block_docs)
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    values = (
        sums.withColumn("f1", f1)
        .join(of_seed, ["replicate", "seed"])
        .groupBy("condition", "replicate")
        .agg(F.when(F.count_if(F.col("f1").isNull()) == 0, F.sum(F.col("f1") * F.col("n_seed")) / F.sum("n_seed")).alias("value"))
    )
    base = F.max(F.when(F.col("condition") == reference, F.col("value"))).over(Window.partitionBy("replicate"))
    both = values.withColumn("delta", F.col("value") - base)
    undefined = F.lit(replicates) - F.count("value")
    held = undefined / replicates > undefined_limit
    return both.groupBy("condition").agg(
        undefined.alias("n_undefined"),
        F.when(~held, F.percentile("value", F.lit(0.025))).alias("lower"), F.when(~held, F.percentile("value", F.lit(0.975))).alias("upper"),
        F.when(~held, F.percentile("delta", F.lit(0.025))).alias("delta_lower"), F.when(~held, F.percentile("delta", F.lit(0.975))).alias("delta_upper"),
        F.when(held, "withheld_excess_undefined_replicates").otherwise("defined").alias("status"))


def _accepted(bits: np.random.MT19937, n: int, count: int) -> np.ndarray:
    """The next `count` numbers below n of a Mersenne stream: the high bits of a word, words too large left out.

    It asks for as many words as are missing, so the stream never runs ahead of what is used.
    """
    found = []
    while count:
        words = bits.random_raw(count) >> np.uint64(32 - n.bit_length())
        found.append(words[words < n].astype(np.int64))
        count -= len(found[-1])
    return np.concatenate(found)


def stream_states(seed: int, n_seeds: int, n_docs: int, replicates: int, every: int) -> list[tuple[np.ndarray, int]]:
    """The state of `random.Random(seed)` before every `every`-th replicate of n_seeds and then n_docs draws: 2.5 kB each."""
    key = random.Random(seed).getstate()[1]
    bits = _from_state((np.array(key[:-1], np.uint32), key[-1]))
    states = []
    for r in range(replicates):
        if r % every == 0:
            at = bits.state["state"]
            states.append((at["key"].copy(), int(at["pos"])))
        _accepted(bits, n_seeds, n_seeds)
        _accepted(bits, n_docs, n_docs)
    return states


def _from_state(state: tuple[np.ndarray, int]) -> np.random.MT19937:
    bits = np.random.MT19937(0)
    bits.state = {"bit_generator": "MT19937", "state": {"key": state[0], "pos": state[1]}}
    return bits


def document_ordinals(counts: DataFrame) -> DataFrame:
    """(doc, at): a document's place in the order of documents, from 0, by range partitions and a prefix sum of their sizes."""
    docs = saved(counts.select("doc").distinct().repartitionByRange("doc").withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = docs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc")) - 1
    return docs.withColumn("place", place).join(F.broadcast(starts), "part").select("doc", (F.col("place") + F.col("start")).alias("at"))


def replayed_bootstrap(counts: DataFrame, reference: str, replicates: int, seed: int, undefined_limit: float = 0.05, every: int = BLOCK_REPLICATES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Percentile intervals of micro-F1, and of its difference to a reference, under one sequential stream of draws.

    A replicate draws as many seeds as there are and then as many documents, with replacement, each from its ordered list by
    the next number of `random.Random(seed)`; all conditions share the draws. The driver walks the bare stream once and saves
    its state before every `every`-th replicate. A task takes one block of documents and one block of replicates, replays the
    stream from the saved state, counts how often each of its documents came, and sends sums; blocks of documents are added.

    The walk is replicates * documents words (about 10^8 a second): for more documents than that allows, and without the
    need to repeat one stream, `hierarchical_bootstrap` draws block by block. `counts` has condition, seed, doc, tp, fp, fn;
    cells that are not there count nothing, null seeds, documents and conditions are no cells. An empty table gives no rows.
    """
    counts = saved(counts.where("condition IS NOT NULL AND seed IS NOT NULL AND doc IS NOT NULL").groupBy("condition", "seed", "doc").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    seeds = [r.seed for r in counts.select("seed").distinct().orderBy("seed").collect()]  # the training seeds, a handful
    ordinals = saved(document_ordinals(counts))
    n_docs = ordinals.count()
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    states = stream_states(seed, len(seeds), n_docs, replicates, every) if n_docs else []

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        first, low = int(pdf["block"].iloc[0]) * every, int(pdf["part"].iloc[0]) * block_docs
        numbers = np.arange(first, min(replicates, first + every))
        mine = min(block_docs, n_docs - low)
        cell, cells = pd.factorize(pd.MultiIndex.from_frame(pdf[["condition", "seed"]]), sort=True)
        values = np.zeros((mine, len(cells), 3))
        np.add.at(values, (pdf["at"].to_numpy() - low, cell), pdf[["tp", "fp", "fn"]].to_numpy(float))
        of_seed, times = np.zeros((len(numbers), len(seeds)), np.int64), np.zeros((len(numbers), mine))
        bits = _from_state(states[first // every])
        for i in range(len(numbers)):
            of_seed[i] = np.bincount(_accepted(bits, len(seeds), len(seeds)), minlength=len(seeds))
            drawn = _accepted(bits, n_docs, n_docs) - low
            times[i] = np.bincount(drawn[(drawn >= 0) & (drawn < mine)], minlength=mine)
        sums = (times @ values.reshape(mine, -1)).reshape(len(numbers), len(cells), 3).round().astype(np.int64)
        of_cell = [seeds.index(s) for s in cells.get_level_values(1)]
        return pd.DataFrame({
            "condition": np.tile(cells.get_level_values(0), len(numbers)), "replicate": np.repeat(numbers, len(cells)), "n_seed": of_seed[:, of_cell].ravel(),
            "seed": np.tile(cells.get_level_values(1), len(numbers)), "tp": sums[..., 0].ravel(), "fp": sums[..., 1].ravel(), "fn": sums[..., 2].ravel()})

    schema = f"condition {kinds['condition']}, replicate long, n_seed long, seed {kinds['seed']}, tp long, fp long, fn long"
    placed = counts.join(ordinals, "doc").withColumn("part", F.floor(F.col("at") / block_docs))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(states) - 1)))))
    sums = blocks.groupBy("part", "block").applyInPandas(replay, schema)
    point = placed.select("condition", F.lit(-1).alias("replicate"), F.lit(1).alias("n_seed"), "seed", "tp", "fp", "fn")
    # a seed that a condition has no cell of is one without counts, and so without a value
    spread = sums.unionByName(point).groupBy("condition", "replicate", "seed", "n_seed").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    whole = F.sum("n_seed") == len(seeds)
    values = (
        spread.where("n_seed > 0").withColumn("f1", f1).groupBy("condition", "replicate")
        .agg(F.when(whole & (F.count_if(F.col("f1").isNull()) == 0), F.sum(F.col("f1") * F.col("n_seed")) / len(seeds)).alias("value"))
    )
    base = F.max(F.when(F.col("condition") == reference, F.col("value"))).over(Window.partitionBy("replicate"))
    both = values.withColumn("delta", F.col("value") - base)
    drawn = F.col("replicate") >= 0
    told = []
    for column, prefix in (("value", ""), ("delta", "delta_")):
        n_undefined = F.lit(replicates) - F.count(F.when(drawn, F.col(column)))
        held = n_undefined / replicates > undefined_limit
        told += [
            F.max(F.when(~drawn, F.col(column))).alias(f"{prefix}point"), n_undefined.alias(f"{prefix}n_undefined"),
            *[F.when(~held, F.percentile(F.when(drawn, F.col(column)), F.lit(q))).alias(f"{prefix}{n}") for n, q in (("lower", 0.025), ("upper", 0.975))],
            F.when(held, "withheld_excess_undefined_replicates").otherwise("defined").alias(f"{prefix}status")]
    return both.groupBy("condition").agg(*told)


def replicate_means(per_seed: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(arm, replicate, mean): an arm's mean over resampled seeds. All arms share one table of draws.

    The draws are numpy's PCG64 integers over the ordered seeds, replicates by seeds; `per_seed` has arm, seed, value.
    """
    spark = per_seed.sparkSession
    seeds = [r.seed for r in per_seed.select("seed").distinct().orderBy("seed").collect()]
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, len(seeds), size=(replicates, len(seeds)))
    times = np.stack([(drawn == i).sum(axis=1) for i in range(len(seeds))], axis=1)
    table = spark.createDataFrame(pd.DataFrame({"replicate": np.repeat(np.arange(replicates), len(seeds)), "seed": np.tile(seeds, replicates), "times": times.ravel()}))
    return per_seed.join(table.where("times > 0"), "seed").groupBy("arm", "replicate").agg((F.sum(F.col("value") * F.col("times")) / len(seeds)).alias("mean"))


def _interval(column: str) -> list[Column]:
    return [F.percentile(column, F.lit(0.025)).alias("lower"), F.percentile(column, F.lit(0.975)).alias("upper")]


def seed_bootstrap(per_seed: DataFrame, replicates: int, seed: int) -> DataFrame:
    """95% intervals of an arm's mean over resampled seeds: arm, lower, upper."""
    return replicate_means(per_seed, replicates, seed).groupBy("arm").agg(*_interval("mean"))


def contrast_bootstrap(per_seed: DataFrame, contrasts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """95% intervals of the difference of two arms' means, replicate by replicate: `contrasts` has arm and reference."""
    means = replicate_means(per_seed, replicates, seed)
    base = means.select(F.col("arm").alias("reference"), "replicate", F.col("mean").alias("base"))
    both = contrasts.join(means, "arm").join(base, ["reference", "replicate"]).withColumn("delta", F.col("mean") - F.col("base"))
    return both.groupBy("arm", "reference").agg(*_interval("delta"))
