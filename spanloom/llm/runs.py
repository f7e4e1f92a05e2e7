"""Runs: bounded sets of whole documents that a task holds at once, for operators that exchange packed arrays, not rows.

A document's run is a hash of its id, so all passes see the same runs. A run has about `RUN_BYTES` of text, and what leaves
it is collapsed to distinct values first: one value costs a run one entry, however many of its documents hold it, so no key
gathers more than one entry per run. Values go to `FANOUT` buckets as one packed block each, so blocks grow with the input
and not with its square; beyond `LEVEL_RUNS` runs they go through further levels (`exchange`), where teams of runs fold what
they share, so a value that all documents hold is one entry per team from there on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import textkit
from spanloom.llm.common import NO_ID

RUN_BYTES = 4 << 20
HELD_BYTES = 24 << 20
FANOUT = 64  # buckets that a run sends tags to
LEVEL_RUNS = 512  # runs that one level of buckets takes
WIDE_RUNS = 8192  # runs up to which buckets are added before levels are


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; the bytes of numbers are stored by significance, which compresses sorted or small ones."""
    columns = [(a.dtype.str, a.shape, np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(columns, protocol=5))


def unpack(block: bytes) -> list[np.ndarray]:
    out = []
    for dtype, shape, data in pickle.loads(zstandard.ZstdDecompressor().decompress(block)):
        width = np.dtype(dtype).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).reshape(shape))
    return out


def n_runs(df: DataFrame, text_col: str, run_bytes: int) -> int:
    total = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(1, -(-total // run_bytes))


def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (doc_id, run, text): (run, block) with the documents that a partition has for a run."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        blocks = [pack(np.array([d for d, _ in docs], np.int64), np.array([len(t) for _, t in docs], np.int64), np.frombuffer(b"".join(t for _, t in docs), np.uint8)) for docs in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blocks, pa.binary())], ["run", "block"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            data, offsets = textkit.raw(part.column(2))
            text = data.tobytes()
            for i, (doc, run) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                held.setdefault(run, []).append((doc, text[offsets[i] : offsets[i + 1]]))
            size += len(text)
            if size > HELD_BYTES:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def run_of(doc_id: Column, runs: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(runs)).cast("int")


def place_of(ids: np.ndarray, runs: int) -> np.ndarray:
    """run_of for numbers in a task: the 64-bit xxHash of a long, with Spark's seed."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1 ^ (np.uint64(42 + 8) + p5)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % runs


def bundled(df: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run, block), dealt by run. Passes over the same frame share its exchange."""
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return (
        df.select(doc_id.alias("doc_id"), run_of(doc_id, runs).alias("run"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(bundle, "run int, block binary")
        .repartition("run")
    )


@dataclass
class Run:
    """Documents in the order of (id, text): ids, offsets (one longer) and bytes."""

    ids: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1


def load(blocks: list[bytes]) -> Run:
    docs: list[tuple[int, bytes]] = []
    for block in blocks:
        ids, lengths, data = unpack(block)
        data, ends = data.tobytes(), np.cumsum(lengths).tolist()
        docs += [(i, data[e - n : e]) for i, n, e in zip(ids.tolist(), lengths.tolist(), ends, strict=True)]
    docs.sort()
    offsets = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(t) for _, t in docs], out=offsets[1:])
    return Run(np.array([i for i, _ in docs], np.int64), offsets, np.frombuffer(b"".join(t for _, t in docs), np.uint8))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` neighbours, by doubling."""
    have, out = 1, keys
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


PLACE_BITS = np.uint64(24)
PLACE = np.uint64((1 << 24) - 1)


def minimisers(hashes: np.ndarray, width: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Places of the leftmost smallest hash (by its upper 40 bits) of every allowed window of `width` neighbours.

    What is chosen in a window depends on the window alone, so equal windows choose the same place in them.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    keys = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    chosen = sliding_min(keys, width) & PLACE
    if allowed is not None:
        chosen = chosen[allowed]
    return np.unique(chosen).astype(np.int64)


def long_minimisers(hashes: np.ndarray, width: int, allowed: np.ndarray, segment: int = 1 << 20) -> np.ndarray:
    """minimisers of any number of hashes, by overlapping segments."""
    found = [minimisers(part, width, allowed[at : at + len(part) - width + 1]) + at for at in range(0, len(hashes), segment) if len(part := hashes[at : at + segment + width - 1]) >= width]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def table(schema: str, *columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def tagged(hashes: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 40-bit tag of each hash."""
    return ((hashes & PLACE) % np.uint64(fanout)).astype(np.int64), hashes >> PLACE_BITS


def distinct_tags(hashes: np.ndarray, fanout: int) -> tuple[np.ndarray, ...]:
    """Order by (bucket, tag); where each distinct pair begins in that order; its number for each place; buckets and tags in order."""
    bucket, tag = tagged(hashes, fanout)
    key = (bucket.astype(np.uint64) << np.uint64(40)) | tag
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1, (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


def ranges(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, begin, end) of each stretch of equal keys."""
    if not len(sorted_keys):
        return []
    edges = [0, *(np.flatnonzero(np.diff(sorted_keys)) + 1).tolist(), len(sorted_keys)]
    return [(int(sorted_keys[i]), i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def buckets(runs: int) -> int:
    """Buckets of one level for so many runs: as many values a bucket as LEVEL_RUNS give it, so that no level, which stores all blocks twice more, is needed.

    Blocks grow with the square of the runs by it; beyond WIDE_RUNS, where they would be smaller than what each costs, levels take over.
    """
    return FANOUT * -(-runs // LEVEL_RUNS) if runs <= WIDE_RUNS else FANOUT


TAGS = "bucket int, run int, block binary"
SHARED = "run int, bucket int, block binary"


def deltas(tags: np.ndarray) -> np.ndarray:
    return np.diff(tags, prepend=np.uint64(0))


def tag_blocks(run: int, hashes: np.ndarray, owners: np.ndarray, fanout: int, payload: tuple[np.ndarray, ...] = ()) -> pa.Table:
    """TAGS of a run: its distinct tags by bucket, sorted, whether several owners of the run hold each, and the payload of the
    first place that holds it."""
    order, first, _, b, t = distinct_tags(hashes, fanout)
    owners = owners[order]
    several = np.minimum.reduceat(owners, first) < np.maximum.reduceat(owners, first) if len(first) else np.zeros(0, bool)
    told = [x[order][first] for x in payload]
    out = [(bucket, pack(deltas(t[first][i:j]), np.packbits(several[i:j]), *(x[i:j] for x in told))) for bucket, i, j in ranges(b[first])]
    return table(TAGS, [x for x, _ in out], [run] * len(out), [x for _, x in out])


@dataclass
class Merged:
    """The blocks of some runs together: tags of all, the number of each one's distinct tag, and of those the tag, whether it is
    shared, and the least payload."""

    sizes: list[int]
    number: np.ndarray
    tags: np.ndarray
    shared: np.ndarray
    payload: list[np.ndarray]


def merged(blocks: list[bytes]) -> Merged:
    parts = [unpack(x) for x in blocks]
    tags = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    several = np.concatenate([np.unpackbits(p[1], count=len(p[0])).astype(bool) for p in parts])
    payload = [np.concatenate([p[i] for p in parts]) for i in range(2, len(parts[0]))]
    order = np.lexsort((*reversed(payload), tags)) if payload else np.argsort(tags, kind="stable")
    t = tags[order]
    new = np.ones(len(order), bool)
    new[1:] = t[1:] != t[:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    size = np.diff(np.append(first, len(order)))
    shared = (size > 1) | (np.logical_or.reduceat(several[order], first) if len(first) else np.zeros(0, bool))
    return Merged([len(p[0]) for p in parts], number, t[first], shared, [x[order][first] for x in payload])


def told(m: Merged, shared: np.ndarray, payload: list[np.ndarray]) -> list[bytes]:
    """For each block of `m`: one bit per tag, set if it is shared, and the payloads of those that are."""
    out, at = [], 0
    for n in m.sizes:
        mine = m.number[at : at + n]
        hit = mine[shared[mine]]
        out.append(pack(np.packbits(shared[mine]), *(x[hit] for x in payload)))
        at += n
    return out


def find_shared(key: tuple, part: pa.Table) -> pa.Table:
    """SHARED of a bucket: which tags of each run another run or another owner of the same run holds."""
    m = merged(part.column("block").to_pylist())
    return table(SHARED, part.column("run").to_pylist(), part.column("bucket").to_pylist(), told(m, m.shared, m.payload))


def by_sub(m: Merged, fanout: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the distinct tags by (sub-bucket, tag), and each sub-bucket's stretch in it."""
    sub = (m.tags % np.uint64(fanout)).astype(np.int64)
    order = np.argsort(sub, kind="stable")
    return order, ranges(sub[order])


def merge_team(fanout: int):
    """The runs of a team as one, dealt to `fanout` buckets below the team's."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        bucket, team = (k.as_py() for k in key)
        m = merged(part.column("block").to_pylist())
        order, subs = by_sub(m, fanout)
        blocks = [pack(deltas(m.tags[o]), np.packbits(m.shared[o]), *(x[o] for x in m.payload)) for _, i, j in subs for o in [order[i:j]]]
        return table(TAGS, [bucket * fanout + s for s, _, _ in subs], [team] * len(subs), blocks)

    return run


def spread_team(fanout: int):
    """What the buckets below have told a team, told to each of its runs."""

    def run(key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
        m = merged(part.column("block").to_pylist())
        order, subs = by_sub(m, fanout)
        answer = dict(zip(replies.column("sub").to_pylist(), map(unpack, replies.column("block").to_pylist()), strict=True))
        shared, payload = np.zeros(len(m.tags), bool), [x.copy() for x in m.payload]
        for s, i, j in subs:
            bits = np.unpackbits(answer[s][0], count=j - i).astype(bool)
            shared[order[i:j]] = bits
            for x, values in zip(payload, answer[s][1:], strict=True):
                x[order[i:j][bits]] = values
        return table(SHARED, part.column("run").to_pylist(), part.column("bucket").to_pylist(), told(m, shared, payload))

    return run


def exchange(tags: DataFrame, runs: int, fanout: int = FANOUT, most: int = LEVEL_RUNS) -> DataFrame:
    """SHARED for TAGS of any number of runs. A run sends `fanout` blocks whatever their number, so blocks grow with the input.

    Where the buckets would hold more than `most` runs, teams of `fanout` runs are merged first, which folds what they share,
    and dealt to `fanout` buckets below each; the answers come back the same way. Levels grow with the logarithm of the runs.
    """
    if runs <= most:
        return tags.groupBy("bucket").applyInArrow(find_shared, SHARED)
    teams = tags.withColumn("team", F.floor(F.col("run") / fanout).cast("int"))
    below = exchange(teams.groupBy("bucket", "team").applyInArrow(merge_team(fanout), TAGS), -(-runs // fanout), fanout, most)
    back = below.select(F.floor(F.col("bucket") / fanout).cast("int").alias("bucket"), F.col("run").alias("team"), (F.col("bucket") % fanout).alias("sub"), "block")
    return teams.groupBy("bucket", "team").cogroup(back.groupBy("bucket", "team")).applyInArrow(spread_team(fanout), SHARED)


def answers(hashes: np.ndarray, replies: pa.Table, fanout: int, blanks: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Which of a run's hashes are shared, from the SHARED rows for the run, and their payloads (blank for the others)."""
    order, first, number, b, _ = distinct_tags(hashes, fanout)
    answer = dict(zip(replies.column("bucket").to_pylist(), replies.column("block").to_pylist(), strict=True))
    shared, payload = np.zeros(len(first), bool), [np.full(len(first), x) for x in blanks]
    for bucket, i, j in ranges(b[first]):
        bits, *values = unpack(answer[bucket])
        hit = np.flatnonzero(np.unpackbits(bits, count=j - i)) + i
        shared[hit] = True
        for x, v in zip(payload, values, strict=True):
            x[hit] = v
    out = [np.zeros(len(hashes), bool), *(np.full(len(hashes), x) for x in blanks)]
    for x, v in zip(out, (shared, *payload), strict=True):
        if len(first):
            x[order] = v[number]
    return tuple(out)
