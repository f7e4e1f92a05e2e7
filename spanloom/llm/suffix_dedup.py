"""Suffix-array dedup: removes what a 50-byte string of an earlier document covers, by a distributed merge of suffixes.

1. Anchors. In every 50-byte window the 16-byte substring with the smallest hash is its anchor: equal windows have equal
   anchors at equal places, so two windows can only be equal if their anchors are. Runs exchange sorted 40-bit tags of
   their distinct anchors and learn, one bit per tag, which ones another document holds too. All other suffixes are unique.
2. Suffixes. A shared anchor's string is the suffix from it (50 bytes) and then the text before it backwards (34 bytes).
   A run sorts its strings, settles those that an earlier document of its own holds in full, and sends the others as
   sorted, front-coded runs (length of the prefix shared with the one before, then the rest) to the anchor's bucket.
3. Merge. A bucket merges its runs with a loser tree that keeps for each contender how much it shares with the last
   winner, and compares only bytes after that. It yields the order and the shared prefixes of neighbours: classes of equal
   suffix prefixes. For each of the 35 places that the anchor can have in a window, strings in one class with equal text
   before the anchor hold the same window; one with a smaller document covers the others.
4. The covered windows go back to the runs as rows, and are cut out there.

Every exchange is of distinct values per run. A run sends `runs.FANOUT` blocks, however many runs there are; where buckets
would hold more than `runs.LEVEL_RUNS` runs (`MERGED_RUNS` for strings), teams of runs are merged first, by the same loser trees, and dealt to finer
buckets, level by level. Strings that a smaller document equals in full stop at the first level that sees both. All arrays are
bounded by a run or a bucket, and nothing passes through the driver but the total of bytes.

Defined cases: a null text is empty; a null id counts as larger than all others; rows that repeat an id are one document for
the comparison of ids and are each cut by themselves; texts under 50 bytes lose nothing; very long texts are a run of their
own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import runs, textkit
from spanloom.llm.textkit import U64

LENGTH = 50
RUN_BYTES = 8 << 20  # larger runs send fewer distinct strings
MERGED_RUNS = 256  # runs whose strings one level of buckets takes: strings take more room than tags
ANCHOR = 16
BEFORE = LENGTH - ANCHOR
WIDTH = LENGTH + BEFORE
SEGMENT = 1 << 20
OUTSIDE = 255  # never a byte of UTF-8


def anchors(run: runs.Run) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie in one document."""
    room = np.zeros(len(run.data), bool)  # where a window may begin
    for a, b in zip(run.offsets[:-1].tolist(), run.offsets[1:].tolist(), strict=True):
        room[a : max(a, b - LENGTH + 1)] = True
    places, hashes = [], []
    for at in range(0, len(run.data), SEGMENT):
        part = run.data[at : at + SEGMENT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        prefix = textkit.byte_prefix(part)
        begins = np.arange(len(part) - ANCHOR + 1)
        h = textkit.range_hash(prefix, begins, begins + ANCHOR)
        found = runs.minimisers(h, BEFORE + 1, room[at : at + len(part) - LENGTH + 1])
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def send_tags(key: tuple, part: pa.Table) -> pa.Table:
    run = runs.load(part.column("block").to_pylist())
    places, hashes = anchors(run)
    return runs.tag_blocks(key[0].as_py(), hashes, run.ids[run.doc(places)], runs.FANOUT)


def strings(run: runs.Run, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of WIDTH bytes per place: the suffix, then the text before it backwards; and the range of places in a window."""
    doc = run.doc(places)
    left = places - run.offsets[doc]
    right = run.offsets[doc + 1] - places
    fill = np.full(WIDTH, OUTSIDE, np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([fill, run.data, fill]), WIDTH)[places + WIDTH - BEFORE]
    rows = np.concatenate([around[:, BEFORE:], around[:, BEFORE - 1 :: -1]], axis=1)
    step = np.arange(WIDTH)
    for edge in (np.flatnonzero(right < LENGTH), np.flatnonzero(left < BEFORE)):
        part = rows[edge]
        part[(step < LENGTH) & (step >= right[edge, None])] = OUTSIDE
        part[(step >= LENGTH) & (step - LENGTH >= left[edge, None])] = OUTSIDE
        rows[edge] = part
    return rows, np.maximum(0, LENGTH - right), np.minimum(BEFORE, left)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How much each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 1 << 16):
        a, b = rows[at - 1 : at - 1 + (1 << 16)], rows[at : at + (1 << 16)]
        same = a[: len(b)] == b
        out[at : at + len(b)] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return out


def place_bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits low .. high."""
    one = U64(1)
    bits = (one << (high + 1).astype(U64)) - (one << low.astype(U64))
    return np.where(low <= high, bits, U64(0))


SUFFIXES = "bucket int, run int, settled int, block binary"


def settled_and_sent(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted strings those that one of a smaller document equals in full, and the rest."""
    first = np.flatnonzero(common_prefixes(rows) < WIDTH) if len(rows) else np.zeros(0, np.int64)
    lowest = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids)))) if len(first) else ids
    return np.flatnonzero(ids > lowest), np.flatnonzero(ids <= lowest)


def front_coded(rows: np.ndarray, *fields: np.ndarray) -> bytes:
    """A sorted run of strings: what each shares with the one before, then the rest; and the fields of each."""
    shares = common_prefixes(rows)
    return runs.pack(shares.astype(np.uint8), rows[np.arange(WIDTH) >= shares[:, None]], *fields)


def send_suffixes(key: tuple, part: pa.Table, replies: pa.Table) -> pa.Table:
    run, number = runs.load(part.column("block").to_pylist()), key[0].as_py()
    places, hashes = anchors(run)
    (chosen,) = runs.answers(hashes, replies, runs.FANOUT)
    places, bucket = places[chosen], runs.tagged(hashes[chosen], runs.FANOUT)[0]
    rows, low, high = strings(run, places)
    ended = np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], axis=1)  # so that no trailing zero byte is lost
    order = np.argsort(ended.view(f"S{WIDTH + 1}").ravel(), kind="stable")
    places, bucket, rows, low, high = (x[order] for x in (places, bucket, rows, low, high))
    ids = run.ids[run.doc(places)]
    later, keep = settled_and_sent(rows, ids)
    out = [(number % runs.FANOUT, 1, runs.pack(np.full(len(later), number, np.int32), places[later], place_bits(low[later], high[later])))]
    keep = keep[np.argsort(bucket[keep], kind="stable")]
    for b, i, j in runs.ranges(bucket[keep]):
        mine = keep[i:j]
        home = np.full(len(mine), number, np.int32)
        out.append((b, 0, front_coded(rows[mine], ids[mine], home, places[mine], low[mine].astype(np.uint8), high[mine].astype(np.uint8))))
    return runs.table(SUFFIXES, [x for x, _, _ in out], [number] * len(out), [x for _, x, _ in out], [x for _, _, x in out])


def merge(streams: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Loser tree over sorted strings with shared prefixes: the stream of each string in order, and what it shares with the last.

    `known[s]` is how much stream s's next string shares with the last winner. Of two contenders the one that shares more is
    the smaller, and the loser's share with the winner is the lesser of the two; only for equal shares are bytes compared,
    from that share on. A finished stream has share -1.
    """
    size = 1
    while size < len(streams):
        size *= 2
    known = [0 if s < len(streams) and streams[s][0] else -1 for s in range(size)]
    at = [0] * size
    now = [streams[s][0][0] if known[s] == 0 else b"" for s in range(size)]
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if x < y:
            return b, a
        if x < 0:
            return a, b
        p, q = now[a], now[b]
        rest_p, rest_q = p[x:], q[x:]
        if rest_p == rest_q:
            known[max(a, b)] = len(p)
            return min(a, b), max(a, b)
        differ = int.from_bytes(rest_p, "big") ^ int.from_bytes(rest_q, "big")
        share = len(p) - (differ.bit_length() + 7) // 8
        if rest_p < rest_q:
            known[b] = share
            return a, b
        known[a] = share
        return b, a

    level = list(range(size))
    base = size // 2
    while len(level) > 1:
        winners = []
        for i in range(0, len(level), 2):
            winner, losers[base + i // 2] = play(level[i], level[i + 1])
            winners.append(winner)
        level, base = winners, base // 2
    winner = level[0]
    order, shares = [], []
    while known[winner] >= 0:
        order.append(winner)
        shares.append(known[winner])
        texts, common = streams[winner]
        at[winner] += 1
        if at[winner] < len(texts):
            now[winner] = texts[at[winner]]
            known[winner] = common[at[winner]]
        else:
            known[winner] = -1
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return order, shares


def decode(shares: np.ndarray, rest: np.ndarray) -> list[bytes]:
    rest, at, last, out = rest.tobytes(), 0, b"", []
    for share in shares.tolist():
        last = last[:share] + rest[at : at + WIDTH - share]
        at += WIDTH - share
        out.append(last)
    return out


@dataclass
class Sorted:
    """Strings of several runs in one order: bytes, shares with the string before, and ids, home runs, places, low and high."""

    rows: np.ndarray
    shares: np.ndarray
    fields: list[np.ndarray]


def opened(part: pa.Table) -> tuple[list[bytes], Sorted | None]:
    """Blocks that are settled, and all others merged."""
    names, settled, blocks = (part.column(c).to_pylist() for c in ("run", "settled", "block"))
    done = [block for is_done, block in zip(settled, blocks, strict=True) if is_done]
    sent = sorted((run, block) for run, is_done, block in zip(names, settled, blocks, strict=True) if not is_done)
    if not sent:
        return done, None
    fields = [runs.unpack(block) for _, block in sent]
    texts = [decode(f[0], f[1]) for f in fields]
    order, shares = merge([(t, f[0].tolist()) for t, f in zip(texts, fields, strict=True)])
    order = np.array(order, np.int64)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    nth = np.argsort(np.argsort(order, kind="stable"), kind="stable") - base[order]
    at = base[order] + nth  # place of each merged string among the concatenated streams
    rows = np.frombuffer(b"".join(b"".join(t) for t in texts), np.uint8).reshape(-1, WIDTH)[at]
    return done, Sorted(rows, np.array(shares), [np.concatenate([f[i] for f in fields])[at] for i in range(2, 7)])


def merge_team(fanout: int):
    """The sorted runs of a team as one, without the strings that a smaller document of the team equals, dealt to the buckets below."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        bucket, team = (k.as_py() for k in key)
        done, merged = opened(part)
        out = [(bucket * fanout, 1, block) for block in done]
        if merged:
            ids, home, places, low, high = merged.fields
            later, keep = settled_and_sent(merged.rows, ids)
            out.append((bucket * fanout, 1, runs.pack(home[later], places[later], place_bits(low[later].astype(np.int64), high[later].astype(np.int64)))))
            # equal anchors stay together: they are dealt by their bytes
            named = np.zeros(len(keep), U64)
            for i in range(ANCHOR):
                named = named * U64(textkit.BASE) + textkit.BYTE_HASH[merged.rows[keep, i]]
            sub = (textkit.mix(named ^ textkit.mix(np.full(len(keep), bucket, U64))) % U64(fanout)).astype(np.int64)
            order = np.argsort(sub, kind="stable")
            for s, i, j in runs.ranges(sub[order]):
                mine = keep[order[i:j]]
                out.append((bucket * fanout + s, 0, front_coded(merged.rows[mine], *(f[mine] for f in merged.fields))))
        return runs.table(SUFFIXES, [x for x, _, _ in out], [team] * len(out), [x for _, x, _ in out], [x for _, _, x in out])

    return run


COVERED = "run int, place long, mask long"


def merge_suffixes(key: tuple, part: pa.Table) -> pa.Table:
    """Which windows of each run an earlier document covers: places of anchors, and bits of their places in the window."""
    done, merged = opened(part)
    told = [runs.unpack(block) for block in done]
    if merged:
        ids, home, places, low, high = merged.fields
        mask = covered_places(merged.rows, merged.shares, ids, low, high)
        told.append([home[mask != 0], places[mask != 0], mask[mask != 0]])
    run, place, mask = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0), np.zeros(0), np.zeros(0))
    columns = [pa.array(run.astype(np.int32)), pa.array(place.astype(np.int64)), pa.array(mask.astype(np.uint64).view(np.int64))]
    return pa.table(columns, names=["run", "place", "mask"])


def covered_windows(suffixes: DataFrame, n_runs: int, fanout: int, most: int) -> DataFrame:
    """COVERED from the sorted runs: merged in teams, level by level, until the buckets of a level take all runs."""
    if n_runs <= most:
        return suffixes.groupBy("bucket").applyInArrow(merge_suffixes, COVERED)
    teams = suffixes.withColumn("team", F.floor(F.col("run") / fanout).cast("int"))
    return covered_windows(teams.groupBy("bucket", "team").applyInArrow(merge_team(fanout), SUFFIXES), -(-n_runs // fanout), fanout, most)


def covered_places(rows: np.ndarray, shares: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits of the places in a window at which a smaller document holds the same window. Rows are in order."""
    before = np.zeros(len(rows), U64)
    mask = np.zeros(len(rows), U64)
    for place in range(BEFORE + 1):
        if place:
            before = textkit.mix(before + textkit.BYTE_HASH[rows[:, LENGTH + place - 1]])
        suffix = np.cumsum(shares < LENGTH - place).astype(U64)  # classes of equal suffix prefixes
        valid = np.flatnonzero((low <= place) & (place <= high))
        if not len(valid):
            continue
        key = textkit.mix(before[valid] ^ textkit.mix(suffix[valid]))
        order = valid[np.argsort(key)]
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
        mask[order[ids[order] > lowest]] |= U64(1 << place)
    return mask


CUT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def cut(key: tuple, part: pa.Table, covered: pa.Table) -> pa.Table:
    run = runs.load(part.column("block").to_pylist())
    begins = np.zeros(len(run.data) + 1, np.int64)
    places, mask = covered.column("place").to_numpy(), covered.column("mask").to_numpy()
    for place in range(BEFORE + 1):
        begins[places[(mask >> place) & 1 == 1] - place] = 1
    total = np.cumsum(begins)
    total[LENGTH:] -= total[:-LENGTH].copy()
    gone = total[: len(run.data)] > 0
    ids, sizes, starts, ends, kept = [], [], [], [], []
    for doc, a, b in zip(run.ids.tolist(), run.offsets[:-1].tolist(), run.offsets[1:].tolist(), strict=True):
        mine = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
        ids.append(None if doc == runs.NO_ID else doc)
        sizes.append(b - a)
        starts.append(edges[::2])
        ends.append(edges[1::2])
        kept.append(run.data[a:b][~mine].tobytes() if len(edges) else run.data[a:b].tobytes())
    longs = pa.list_(pa.int64())
    return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())], names=[f.split()[0] for f in CUT.split(", ")])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES, fanout: int = runs.FANOUT, most: int = runs.LEVEL_RUNS) -> DataFrame:
    """One row per row of `df`: doc_id, n_bytes, starts and ends of the removed ranges (bytes), kept (the bytes left)."""
    n = runs.n_runs(df, text_col, run_bytes)
    bundles = runs.bundled(df, n, id_col, text_col)
    shared = runs.exchange(bundles.groupBy("run").applyInArrow(send_tags, runs.TAGS), n, fanout, most)
    suffixes = bundles.groupBy("run").cogroup(shared.groupBy("run")).applyInArrow(send_suffixes, SUFFIXES)
    covered = covered_windows(suffixes, n, fanout, min(most, MERGED_RUNS))
    return bundles.groupBy("run").cogroup(covered.groupBy("run")).applyInArrow(cut, CUT)
