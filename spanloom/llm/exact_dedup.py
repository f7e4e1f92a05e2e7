"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of each partition find the digests that may cover more than `heavy_share` of the rows. Their exact
counts and winners are verified and broadcast, so rows of huge groups are decided on the map side and never shuffled;
all other digests go through an ordinary partial aggregation and join.

The broadcast is bounded: summed estimates are at most the number of rows, and a candidate needs heavy_share - 1/(counters+1)
of them, so there are at most 1 / (heavy_share - 1/(counters+1)) candidates (341 by default) at any input size.

Defined cases: a null text is empty; empty texts are equal to each other; a null id ranks after every other id; rows that
repeat both id and text are still one group, of which exactly one row is kept; very long texts are hashed whole; an empty
table gives no rows; other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import NO_ID, SPACE_RUN, written
from spanloom.operators import slots

HEAVY_SHARE = 1 / 256
COUNTERS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def misra_gries(counters: int):
    """Arrow map over one column of digests: the partition's summary, with at most `counters` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in Counter(batch.column(0).to_pylist()).items():
                held[digest] = held.get(digest, 0) + n
            if len(held) > counters:  # subtract the (counters+1)-th largest from all: the mergeable form of the decrement
                cut = sorted(held.values(), reverse=True)[counters]
                held = {digest: n - cut for digest, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "estimate"])

    return summarise


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `df`: doc_id, digest (binary), keep_id, group_size, kept."""
    digests = written(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    n_rows = digests.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    size = F.count(F.lit(1)).alias("group_size")

    candidates = (
        digests.select("digest")
        .mapInArrow(misra_gries(counters), "digest binary, estimate long")
        .groupBy("digest")
        .agg(F.sum("estimate").alias("estimate"))
        .where(F.col("estimate") >= n_rows * (heavy_share - 1 / (counters + 1)))
        .select("digest")
    )
    winners = digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(first, size)

    marked = digests.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("group_size IS NOT NULL")
    light = marked.where("group_size IS NULL").select("doc_id", "digest", "row")
    rest = light.join(light.groupBy("digest").agg(first, size), "digest")
    return heavy.unionByName(rest).select(
        "doc_id",
        "digest",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each group of equal texts, all columns as they were. Texts stay where they are, but those
    that a bit map of what goes lets through."""
    keys = ["doc_id", "digest"]

    def filled(doc_id: Column) -> Column:
        return F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("doc_id")

    judged = groups(df, id_col, text_col).select(filled(F.col("doc_id")), "digest", "kept").groupBy(*keys).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    judged = written(judged.where("NOT stays OR n > 1"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, filled(F.col(id_col)), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    left = slots.without(rows, judged.where("NOT stays").select(*keys), *keys)
    again = judged.where("stays").select(*keys)  # rows that repeat id and text, one of which stays
    if not again.isEmpty():
        left = left.join(again, keys, "left_anti").unionByName(left.join(again, keys, "left_semi").dropDuplicates(keys))
    return left.select(*[F.col(f"row.`{c}`") for c in df.columns])
