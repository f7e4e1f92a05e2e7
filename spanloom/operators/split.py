"""Iterative multilabel stratification in two folds: the rarest label's rows first, each to the fold that still wants it most.

Which label is the rarest does not depend on where rows go, so the order of the labels and the label by which a row is dealt
follow from the counts of distinct label sets alone. Within a label the folds come in a sequence that depends on two quotas and
two capacities, not on the rows, and has a closed form: the fold with the larger quota until the lead is less than a row, then
turns, since each row moves the lead by one to the other side. A label is a handful of runs, however many rows it has. Where
quotas and capacities are both equal each pair of rows begins with a lot; these are drawn in order and kept as one bit a pair.
Rows without labels come last and are dealt by capacity.

What is left for the data is each row's place in its label's order, found once, and the counts of label sets in each run, which
correct the other labels' quotas. The driver holds distinct label sets, labels, runs and those bits, and never rows.
"""

from __future__ import annotations

import random
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.files import saved

FOLDS = ("train", "development")


def rounds_of(sets: dict[tuple[str, ...], int]) -> list[tuple[str, list[tuple[str, ...]]]]:
    """(label, label sets that it deals) in order: of the labels with rows left the rarest, ties by name."""
    left, out = dict(sets), []
    while left:
        counts: dict[str, int] = {}
        for labels, n in left.items():
            for label in labels:
                counts[label] = counts.get(label, 0) + n
        label = min(counts, key=lambda x: (counts[x], x))
        dealt = sorted(s for s in left if label in s)
        out.append((label, dealt))
        for s in dealt:
            del left[s]
    return out


@dataclass(frozen=True)
class Run:
    """`length` places from `begin`: all to `fold`; or in turns, `fold` first; or in pairs whose first fold is a bit of `lots`."""

    begin: int
    length: int
    fold: int
    kind: str = "all"
    lots: bytes = b""


def runs_of(n: int, want: list[float] | None, room: list[int], ties: random.Random) -> list[Run]:
    """The folds of n rows: each goes to the fold with the larger quota (of rows without labels: none), then with more room, then by lot."""
    want, room, out, at = list(want or ()), list(room), [], 0

    def take(kind: str, fold: int, length: int, lots: bytes = b"", first: int | None = None) -> None:
        """`first`: how many of the rows the fold gets."""
        nonlocal at
        out.append(Run(at, length, fold, kind, lots))
        got = length if first is None else first
        for f, k in ((fold, got), (1 - fold, length - got)):
            room[f] -= k
            if want:
                want[f] -= k
        at += length

    while at < n:
        left = n - at
        if min(room) <= 0:
            take("all", 0 if room[0] > 0 else 1, left)
            continue
        lead = want[0] - want[1] if want else float(room[0] - room[1])
        if lead:
            fold = 0 if lead > 0 else 1
            if abs(lead) >= 1:
                take("all", fold, min(int(abs(lead)), room[fold], left))
            else:
                k = min(left, 2 * min(room))
                take("turns", fold, k, first=(k + 1) // 2)
        elif room[0] != room[1]:  # equal quotas: whoever has more room begins each pair, and still has more after it
            k = min(left, 2 * min(room))
            take("turns", 0 if room[0] > room[1] else 1, k, first=(k + 1) // 2)
        else:
            k = min(left, 2 * room[0])
            drawn = [ties.randrange(2) for _ in range((k + 1) // 2)]
            lots = bytes(sum(bit << i for i, bit in enumerate(drawn[b : b + 8])) for b in range(0, len(drawn), 8))
            take("lots", 1, k, lots, first=k // 2 + (drawn[-1] if k % 2 else 0))  # a row of each pair
    return out


def in_development(place: Column, runs: list[Run]) -> Column:
    """Whether a place lies in the second fold."""
    told = F.lit(False)
    for run in runs:
        inside, step = (place >= run.begin) & (place < run.begin + run.length), place - run.begin
        if run.kind == "turns":
            told = told | (inside & ((step + run.fold) % 2 == 1))
        elif run.kind == "lots":
            pair = F.floor(step / 2).cast("int")
            byte = F.conv(F.hex(F.substring(F.lit(run.lots), F.floor(pair / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.floor(byte / F.pow(F.lit(2), pair % 8)).cast("int") % 2
            told = told | (inside & ((bit + step) % 2 == 1))
        elif run.fold:
            told = told | inside
    return told


def multilabel_split(items: DataFrame, development_size: int, ties: random.Random) -> DataFrame:
    """(id, fold) of items with (id, labels, rank): `development_size` rows in development, the rest in train.

    Rows of a label are dealt in the order of (rank, id), and those without labels after all others; `ties` decides where
    quotas and room are equal. Null labels are none.
    """
    spark = items.sparkSession
    named = items.select("id", "rank", F.array_sort(F.array_distinct(F.coalesce("labels", F.array().cast("array<string>")))).alias("labels"))
    sets = {tuple(r.labels): r["count"] for r in named.groupBy("labels").count().collect()}  # distinct label sets
    total = sum(sets.values())
    if not 0 < development_size < total:
        raise ValueError("both folds need rows")
    order: list[tuple[str | None, list[tuple[str, ...]]]] = [*rounds_of({s: n for s, n in sets.items() if s})]
    if () in sets:
        order.append((None, [()]))
    table = spark.createDataFrame([(list(s), i) for i, (_, dealt) in enumerate(order) for s in dealt], "labels array<string>, round int")
    by_rank = [F.col("rank"), F.col("id")]
    parted = saved(named.join(table, "labels").repartitionByRange("round", *by_rank).withColumn("part", F.spark_partition_id()))
    # places within a round: totals of the range partitions, then numbers within them
    earlier = Window.partitionBy("round").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy("round", "part").agg(F.count(F.lit(1)).alias("n")).select("round", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("round", "part").orderBy(*by_rank)
    placed = saved(
        parted.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(before), ["round", "part"]).select("id", "labels", "round", (F.col("before") + F.col("nth")).alias("place"))
    )
    room = [total - development_size, development_size]
    counts: dict[str, int] = {}
    for labels, n in sets.items():
        for label in labels:
            counts[label] = counts.get(label, 0) + n
    want = {label: [n * room[0] / total, n * room[1] / total] for label, n in counts.items()}
    fold = F.lit(False)
    for i, (label, dealt) in enumerate(order):
        runs = runs_of(sum(sets[s] for s in dealt), None if label is None else want[label], room, ties)
        chosen = in_development(F.col("place"), runs)
        found = placed.where(F.col("round") == i).groupBy("labels").agg(F.count_if(chosen).alias("n")).collect()
        for row in found:
            taken = [sets[tuple(row.labels)] - row.n, row.n]
            for f in (0, 1):
                room[f] -= taken[f]
                for other in row.labels:
                    want[other][f] -= taken[f]
        fold = F.when(F.col("round") == i, chosen).otherwise(fold)
    return placed.select("id", F.when(fold, FOLDS[1]).otherwise(FOLDS[0]).alias("fold"))


def canonical_uuid(text: str) -> bool:
    try:
        return str(uuid.UUID(text)) == text
    except (ValueError, AttributeError, TypeError):
        return False


def official_split(items: DataFrame, test: DataFrame, train_size: int = 586, development_size: int = 103, test_size: int = 173, seed: int = 42) -> DataFrame:
    """(id, fold) over train, development and test: the protocol's fixed sizes. `items` (id, labels) and `test` (id).

    Refused: other sizes, ids that repeat or are on both sides, and ids that are not UUIDs in canonical writing. These few ids
    are looked at on the driver, and ranked by the draws of one generator in the order of the ids; that generator goes on to the lots.
    """
    spark, most = items.sparkSession, train_size + development_size
    held = [r.id for r in items.select("id").limit(most + 1).collect()]
    kept = [r.id for r in test.select("id").limit(test_size + 1).collect()]
    if len(held) != most or len(kept) != test_size:
        raise ValueError(f"the split needs {most} items and {test_size} test ids")
    if len({*held, *kept}) != most + test_size:
        raise ValueError("ids must be unique, and on one side of the boundary")
    wrong = [i for i in (*held, *kept) if not canonical_uuid(i)]
    if wrong:
        raise ValueError(f"not a canonical UUID: {min(map(str, wrong))!r}")
    draws = random.Random(seed)
    ranks = spark.createDataFrame([(i, draws.random()) for i in sorted(held)], "id string, rank double")
    dealt = multilabel_split(items.select("id", "labels").join(F.broadcast(ranks), "id"), development_size, draws)
    return dealt.unionByName(test.select("id", F.lit("test").alias("fold")))
