"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

Targets: all words are shared among the sources by weight; a target stops at `most` times its source's words and the
excess is shared again by weight (water filling, in closed form over the sources sorted by cap / weight).

Inclusion: a document's expected number of copies is e = min(most, c * bits), `bits` being the binary digits of its size, so
long texts are likelier than short ones; c is such that the expected words of a source are its target. It comes in closed
form from the words of each (source, bits), a table of some forty rows a source.

Selection: floor(e) copies of a document are certain. The rest of the target is a fixed-size sample with inclusion
probabilities p = e - floor(e), which differ between documents: they are ranked by (u / (1 - u)) / (p / (1 - p)), u being
fixed by id and text, and taken in that order until the words left are reached. The document at the border is taken if
that comes nearer to the target, so a source misses its target by half a document at most.

No task holds a source: the ratio r is mapped to r / (1 + r), cut into bins, and words are summed per (source, bin) with
partial aggregation. Bins before the border are taken whole, those after it not; only rows of the one bin that holds a
source's border are ranked. There are at least `bins` bins and one for each `BIN_ROWS` rows.

Defined cases: a null text has size 0 and a null source is a source of its own, weighed last; a document of size 0 is never
taken; a null id draws by its text alone, so rows without ids differ as their texts do; rows that repeat id and text draw the
same number and stand next to each other, and as many of them are taken as there are words left for, each counted by itself;
very long texts are sized whole; an empty table gives no rows; the columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, uniform, written

SEED = "mixing-2"
BINS = 4096
BIN_ROWS = 2048
MOST = 3


def n_words(text: Column) -> Column:
    """Words, each made one letter and the white space dropped: no array of them is built."""
    letters = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size). The frame has one row per source, and is ordered as a whole."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * most
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("rank", F.row_number().over(in_order))
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        # the water line: the first level that its own source does not stop
        .withColumn("line", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("line"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, carry: Column | None = None) -> DataFrame:
    """doc_id, source, size, bits, u of each row, and `carry` as row."""
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        uniform(key, seed).alias("u"),
        *([] if carry is None else [carry.alias("row")]),
    )
    return rows.withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def expected(sized: DataFrame, most: int = MOST) -> DataFrame:
    """in_source, in_bits, source_size, target, whole, p, left_over: a row for each source and number of binary digits."""
    words = sized.groupBy("source", "bits").agg(F.sum("size").alias("words"))
    goals = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), most)
    of = words.select(F.col("source").alias("in_source"), F.col("bits").alias("in_bits"), "words")
    long_first = Window.partitionBy("in_source").orderBy(F.col("in_bits").desc())
    whole_source = Window.partitionBy("in_source")
    above = F.coalesce(F.sum("words").over(long_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("in_bits") * F.col("words")).over(long_first.rowsBetween(0, Window.unboundedFollowing))
    c = F.when(F.col("below") > 0, (F.col("target") - most * F.col("above")) / F.col("below"))
    fits = F.col("c") * F.col("in_bits") <= most * (1 + 1e-9)  # the longest class that its own c does not stop at `most`
    return (
        of.join(goals, F.col("in_source").eqNullSafe(F.col("source")))
        .withColumn("above", above)
        .withColumn("below", below)
        .withColumn("c", c)
        .withColumn("slope", F.max(F.when(fits & (F.col("in_bits") > 0), F.struct("in_bits", "c"))).over(whole_source)["c"])
        .withColumn("e", F.when(F.col("in_bits") > 0, F.least(F.lit(float(most)), F.coalesce("slope", F.lit(float(most))) * F.col("in_bits"))).otherwise(0.0))
        .withColumn("whole", F.floor("e"))
        .withColumn("p", F.col("e") - F.col("whole"))
        .withColumn("left_over", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source))
        .select("in_source", "in_bits", "source_size", "target", "whole", "p", "left_over")
    )


def ranked(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """Rows with their source's plan, their place in its order (v, of 0 to 1; null without chance) and the bin of that."""
    odds = F.col("u") / (1 - F.col("u"))
    chance = F.col("p") / (1 - F.col("p"))
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("bits") == F.col("in_bits")))
        .withColumn("v", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (odds + chance)))
        .withColumn("bin", F.floor(F.col("v") * bins).cast("long"))
    )


def with_borders(sized: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """The plan with the bin that holds each source's border, and the words in the bins before it."""
    by_bin = ranked(sized, plan, bins).where("bin IS NOT NULL").groupBy("source", "bin", "left_over").agg(F.sum("size").alias("bin_size"))
    so_far = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        by_bin.withColumn("reached", F.sum("bin_size").over(so_far))
        .where(F.col("reached") >= F.col("left_over"))
        .groupBy(F.col("source").alias("of_source"))
        .agg(F.min(F.struct("bin", (F.col("reached") - F.col("bin_size")).alias("before"))).alias("first"))
        .select("of_source", F.col("first.bin").alias("border"), F.col("first.before").alias("before"))
    )
    return plan.join(border, F.col("in_source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def decided(rows: DataFrame, plan: DataFrame, bins: int) -> DataFrame:
    """Rows with their copies."""
    placed = ranked(rows, plan, bins)
    inside = F.col("bin").isNotNull() & (F.col("bin") == F.col("border"))
    clear = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.coalesce(F.col("bin") < F.coalesce("border", F.lit(bins + 1)), F.lit(False)))
    order = Window.partitionBy("source").orderBy("v", "u", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("before") + F.sum("size").over(order)
    edge = placed.where(inside).withColumn("extra", 2 * reached - F.col("size") <= 2 * F.col("left_over"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("int")).otherwise(0)
    return clear.unionByName(edge).withColumn("copies", copies.cast("long"))


def planned(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, most: int, bins: int) -> tuple[DataFrame, DataFrame, int]:
    """The sizes of all rows (a written table), the plan (a written table of some forty rows a source) and the number of bins."""
    sized = written(measured(df, id_col, text_col, source_col, seed))
    bins = max(bins, sized.count() // BIN_ROWS)
    plan = written(expected(sized, most))
    return sized, written(with_borders(sized, plan, bins)), bins


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, most: int = MOST, bins: int = BINS) -> DataFrame:
    """One row per row of `df`: doc_id, source, size, source_size, target, p, copies, taken (= copies * size)."""
    sized, plan, bins = planned(df, id_col, text_col, source_col, seed, most, bins)
    return decided(sized, plan, bins).select("doc_id", "source", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, most: int = MOST, bins: int = BINS) -> DataFrame:
    """The mix itself: rows of `df` repeated as often as they are taken, all columns as they were. Rows meet the plan, not each other."""
    columns = df.columns
    _, plan, bins = planned(df, id_col, text_col, source_col, seed, most, bins)
    rows = measured(df, id_col, text_col, source_col, seed, F.struct(*[F.col(f"`{c}`") for c in columns]))
    chosen = decided(rows, plan, bins).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"row.`{c}`") for c in columns])
