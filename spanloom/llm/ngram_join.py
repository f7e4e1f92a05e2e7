"""N-gram Jaccard join with rare-first prefix filtering.

A text's set holds the hashes of its distinct n-word shingles (fewer words: the whole sequence; no words: nothing). Texts
with equal sets are one node, so copies are never compared. The order of shingles is rare first: by how often shingles of
their hash bucket occur (a sketch of fixed size over all texts), then by hash. Two sets with Jaccard >= t share a shingle in
their prefixes of n - ceil(t n) + 1, so nodes are joined on prefix shingles only.

Prefix shingles are plain rows that Spark deals by shingle; what one node alone holds goes in the same pass. A shingle of a
bucket that is far above the mean is dealt in several parts, and such parts are kept for the next step to judge.

Pairs: within a group of nodes that hold one prefix shingle, two hubs first meet all other members, so a group costs its
size and not its square; the hubs are the nodes whose shingles are shared most (of either half of the node names), the
centres of near copies. Links merge components, and a group whose members have met in one component is done. Whatever members
of a group are still in different components are then paired in full, so that no link is lost: pairs left out are already
connected. Hubs are maxima, found with partial aggregation, and a group meets them in a join that Spark may split, so a hot
group does not end in one task. Length and positional filters and small sketches prune pairs before their sets are fetched,
the suffix filter before they are intersected, and a pair is verified once.

Components: tasks contract `EDGES` links at a time to trees; where that takes more than one task, large-star/small-star rounds
on written tables join the trees.

Nodes are named by 64-bit hashes of their sets. Defined cases: a null or empty text is linked with nothing and is its own
component; a null id counts as larger than all others; rows that repeat an id are judged each by its own text; very long
texts are read whole; an empty table gives no rows; other columns are not looked at and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import textkit
from spanloom.llm.common import NO_ID, dropped, written
from spanloom.llm.textkit import U64
from spanloom.operators import slots

BUCKETS = 1 << 16
AHEAD = 6
SKETCH = 8
SUFFIX_DEPTH = 3
HOT = 1 << 16
EDGES = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; two sets link when `of` * intersection >= `least` * union."""

    words: int = 5
    least: int = 80
    of: int = 100

    def overlap(self, total):
        """Least intersection of two sets with `total` elements together: least / (of + least) of them, rounded up."""
        return -((-self.least * total) // (self.of + self.least))

    def partner(self, n):
        """Least size of a set that can link with one of n elements."""
        return -((-self.least * n) // self.of)

    def prefix(self, n):
        return n - self.partner(n) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = textkit.LOWER[data]
    starts, ends, of_text = textkit.words(data, offsets)
    hashes = textkit.range_hash(textkit.byte_prefix(data), starts, ends)
    grams, at = textkit.windows(hashes, of_text, words)
    counts = np.diff(of_text)
    short = np.flatnonzero((counts > 0) & (counts < words))
    whole = textkit.range_hash(textkit.prefix(hashes), of_text[short], of_text[short + 1]) if len(short) else None
    sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for i, row in enumerate(short.tolist()):
        sets[row] = whole[i : i + 1]
    return sets


def name(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    first = int(textkit.mix(shingles).sum(dtype=U64))
    second = int(textkit.mix(shingles ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64))
    total = (first + second * textkit.BASE + len(shingles)) % 2**64
    return int(textkit.mix(np.array([total], U64)).astype(np.int64)[0])


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(48)).astype(np.int64)


DESCRIBED = "doc_id long, copy long, n long, node long, bits binary, bucket long, hits long"


def describe(words: int):
    """Arrow map over (doc_id, copy, text): (doc_id, copy, n, node, bits), a row per text, and then (bucket, hits) per used bucket of the partition."""
    names = [c.split()[0] for c in DESCRIBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for row, end, data, offsets in textkit.pieces(batch.column(2)):
                sets = shingle_sets(data, offsets, words)
                totals += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS)
                none = pa.nulls(len(sets), pa.int64())
                told = [pa.array([len(s) for s in sets], pa.int64()), pa.array([name(s) for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row) for i in (0, 1)), *told, none, none], names)
        used = np.flatnonzero(totals)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(used), pa.binary()), pa.array(used), pa.array(totals[used])], names)

    return run


TOKENS = "token long, part int, node long, n int, at int"


def prefixes(rule: Rule, rank: np.ndarray):
    """Arrow map over (text): TOKENS, the prefix shingles of the distinct sets of a partition; at is the place in the set, rare first.

    part is 0 but for shingles of buckets far above the mean, which come in several parts from 1 on.
    """
    parts = 1 + rank // (HOT + 4 * int(rank.mean()))
    names = [c.split()[0] for c in TOKENS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in textkit.pieces(batch.column(0)):
                tokens, nodes, sizes = [], [], []
                for s in shingle_sets(data, offsets, rule.words):
                    if not len(s) or (node := name(s)) in seen:
                        continue
                    seen.add(node)
                    n = len(s)
                    k = rule.prefix(n)
                    hits = rank[bucket(s)]
                    if k < n:
                        edge = np.partition(hits, k - 1)[k - 1]
                        s, hits = s[hits <= edge], hits[hits <= edge]
                    tokens.append(s[np.lexsort((s, hits))][:k])
                    nodes.append(node)
                    sizes.append((n, k))
                if not tokens:
                    continue
                n, k = np.array(sizes).T
                token, node = np.concatenate(tokens), np.repeat(np.array(nodes, np.int64), k)
                spread = parts[bucket(token)]
                part = np.where(spread > 1, 1 + (textkit.mix(node.astype(U64)) % spread.astype(U64)).astype(np.int64), 0)
                at = np.arange(len(token)) - np.repeat(np.cumsum(k) - k, k)
                columns = [pa.array(token.astype(np.int64)), *(pa.array(x, kind) for x, kind in ((part, pa.int32()), (node, pa.int64()), (np.repeat(n, k), pa.int32()), (at, pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


SETS = "node long, shingles binary"


def sets_of(words: int):
    """Arrow map over (node, text): the sorted sets of the texts that are the node's (a row that repeats the id may have another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in textkit.pieces(batch.column(1)):
                nodes = batch.column(0).slice(row, end - row).to_pylist()
                sets = [(node, s.tobytes()) for node, s in zip(nodes, shingle_sets(data, offsets, words), strict=True) if len(s) and name(s) == node]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], ["node", "shingles"])

    return run


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles over a power of two of bits, at least SKETCH of them per shingle."""
    size = 1 << max(8, (SKETCH * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: each shingle that one set alone holds flips one bit at most."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))  # the longer one folds onto the shorter
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def near(rule: Rule):
    """Whether the sketches leave room for enough overlap."""

    def check(a: pd.Series, n_a: pd.Series, b: pd.Series, n_b: pd.Series) -> pd.Series:
        total = n_a.to_numpy(np.int64) + n_b.to_numpy(np.int64)
        room = (total - 2 * rule.overlap(total)).tolist()
        return pd.Series([sketch_distance(x, y) <= most for x, y, most in zip(a, b, room, strict=True)], dtype=bool)

    return F.pandas_udf(check, "boolean")


def suffix_distance(a: np.ndarray, b: np.ndarray, most: int, depth: int = SUFFIX_DEPTH) -> int:
    """A lower bound of the symmetric difference of two sorted sets, by splitting both at the middle of `b`."""
    gap = abs(len(a) - len(b))
    if depth == 0 or gap > most or not len(a) or not len(b):
        return gap
    pivot = b[len(b) // 2]
    i, j = np.searchsorted(a, pivot), len(b) // 2
    found = i < len(a) and a[i] == pivot
    left = suffix_distance(a[:i], b[:j], most, depth - 1)
    rest = most - left - (not found)
    if rest < 0:
        return left + (not found)
    return left + (not found) + suffix_distance(a[i + found :], b[j + 1 :], rest, depth - 1)


def linked(rule: Rule):
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            need = int(rule.overlap(len(x) + len(y)))
            if suffix_distance(x, y, len(x) + len(y) - 2 * need) > len(x) + len(y) - 2 * need:
                out.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            out.append(int((both[1:] == both[:-1]).sum()) >= need)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(verify, "boolean")


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of all nodes of some links but those smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root = root[root]
    led = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[led], nodes[root[led]]


def contract(edges: int):
    """Arrow map over (u, v): links as trees, `edges` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            u, v = contracted(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= edges:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60, edges_a_task: int = EDGES) -> DataFrame:
    """(node, root) of every node in `links`; root is the smallest node it reaches. Done when all edges lead to a root."""
    given = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    tasks = max(1, -(-given.count() // edges_a_task))
    edges = written(given.coalesce(tasks).mapInArrow(contract(edges_a_task), "u long, v long"))
    dropped(given)
    for _ in range(most if tasks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.distinct())
        dropped(before)
        # stars: no node leads on and is led to, and none leads to two
        sides = edges.select("u", F.lit(1).alias("k")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("k")).distinct())
        if sides.groupBy("u").agg(F.sum("k").alias("out"), F.count(F.lit(1)).alias("n")).where("out > 0 AND n > 1").isEmpty():
            break
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def passing(met: DataFrame, rule: Rule) -> DataFrame:
    """Length and positional filters on members of a group and their partner o: distinct (a, b, n_a, n_b), a < b."""
    n, at, m, other_at = F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at")
    need = F.ceil(rule.least * (n + m) / F.lit(rule.of + rule.least))
    length = F.least(n, m) * rule.of >= F.greatest(n, m) * rule.least
    # the first shingle that two sets share leaves room for all that they have to share: a linked pair passes there
    reach = F.least(n - at, m - other_at)
    forth = F.col("node") < F.col("o.node")
    return met.where(length & (reach >= need)).select(
        F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"),
        F.when(forth, n).otherwise(m).alias("n_a"), F.when(forth, m).otherwise(n).alias("n_b"),
    ).distinct()


GROUP = ["token", "band"]


def shared_rows(texts: DataFrame, rule: Rule, rank: np.ndarray) -> DataFrame:
    """(token, node, n, at): the prefix shingles that several nodes hold, and those of hot parts."""
    group = Window.partitionBy("token", "part").orderBy("node")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        texts.select("text").mapInArrow(prefixes(rule, rank), TOKENS)
        .repartition("token", "part")
        .select("*", F.min("node").over(whole).alias("low"), F.max("node").over(whole).alias("high"), F.lag("node").over(group).alias("previous"))
        .where("(part > 0 OR low < high) AND (previous IS NULL OR previous <> node)")
        .select("token", "node", "n", "at")
    )


def join(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id (smallest doc_id it reaches)."""
    text = F.col(text_col).cast("string")
    # rows without an id, or that repeat one, are told apart by what they hold
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    described = written(texts.mapInArrow(describe(rule.words), DESCRIBED))
    members = described.where("bucket IS NULL").select("doc_id", "n", "node")
    counts = described.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("hits").alias("hits"))
    rank = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():  # at most BUCKETS rows
        rank[row.bucket] = row.hits

    rows = written(shared_rows(texts, rule, rank))
    # of shingles that the same nodes hold the first in the order stays, since a pair's first shared shingle is what counts
    held = written(rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"), F.min(F.struct("node", "at"))["at"].alias("first_at"),
    ).where("size > 1"))
    telling = held.groupBy("size", "sum", "xor").agg(F.min(F.struct("first_at", "token"))["token"].alias("token")).select("token", F.lit(True).alias("tells"))
    sized = written(rows.join(held.select("token", "size").join(telling, "token", "left"), "token"))
    # the centre of a group of near copies shares the most: it becomes the group's hub
    weight = sized.groupBy("node").agg(F.sum(F.col("size") - 1).alias("weight"))
    # two sets can only link if their sizes are in one band or in neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(rule.of / rule.least)) + 1e-9).cast("int")
    banded = written(sized.where("tells").join(weight, "node").select("token", "node", "n", "at", "weight", F.explode(F.array(band, band + 1)).alias("band")))
    shared = written(banded.join(written(several(banded, "node")), GROUP, "left_semi"))
    dropped(rows, held, sized, banded)

    firsts = described.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "copy")).alias("first")).select("node", F.col("first.doc_id").alias("rep"), F.col("first.copy").alias("copy"))

    def bits(nodes: DataFrame) -> DataFrame:
        return described.where("n > 0").select("node", "bits").join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = written(nodes.join(firsts, "node").select(F.col("rep").alias("doc_id"), "copy", "node"))
        return slots.passing(texts, wanted, "doc_id", "copy").join(wanted, ["doc_id", "copy"]).select("node", "text").mapInArrow(sets_of(rule.words), SETS).dropDuplicates(["node"])

    roots = components(verified_links(shared, bits, sets, rule))
    reps = firsts.select("node", "rep")
    lowest = roots.join(reps, "node").groupBy("root").agg(F.min("rep").alias("component"))
    reps = reps.join(roots, "node", "left").join(lowest, "root", "left").select("node", F.coalesce("component", "rep").alias("rep"))
    return (
        members.join(reps.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
        .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("rep", "doc_id"), F.lit(NO_ID)).alias("component_id"))
    )


def several(rows: DataFrame, of: str) -> DataFrame:
    """The groups with more than one value of a column."""
    return rows.groupBy(*GROUP).agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low < high").select(*GROUP)


Fetch = Callable[[DataFrame], DataFrame]


def verified_links(shared: DataFrame, bits: Fetch, sets: Fetch, rule: Rule) -> DataFrame:
    """Links (a, b) between nodes that connect whatever is connected.

    Pairs that pass all filters nearly always link, so components grow on them first and all are verified together. Where one
    fails, what it had kept apart from comparison is compared again, from the verified links on.
    """
    none = shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    tried = filtered(hub_pairs(shared, rule), bits, rule)
    fresh, good = tried.where("close").select("a", "b"), none
    while True:
        left = merged(shared, good.unionByName(fresh))
        more = filtered(remaining_pairs(left, rule).join(tried.select("a", "b"), ["a", "b"], "left_anti"), bits, rule)
        tried = tried.unionByName(more)
        fresh = fresh.unionByName(more.where("close").select("a", "b"))
        if fresh.isEmpty():
            return good
        nodes = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        full = written(sets(nodes), "uncompressed")
        both = fresh.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
        judged = written(both.select("a", "b", linked(rule)("x", "y").alias("is_link")))
        dropped(full)
        failed = judged.where("NOT is_link")
        if failed.isEmpty():
            return good.unionByName(judged.select("a", "b"))
        # only in a component that a failed pair has grown are there pairs that were not compared
        grown = components(good.unionByName(fresh))
        wrong = failed.select(F.col("a").alias("node")).join(grown, "node").select("root").distinct()
        shared = written(shared.join(grown.join(wrong, "root", "left_semi").select("node"), "node", "left_semi"))
        good, fresh = good.unionByName(judged.where("is_link").select("a", "b")), none


def filtered(pairs: DataFrame, bits: Fetch, rule: Rule) -> DataFrame:
    """(a, b, close): which pairs' sketches leave room for enough overlap."""
    pairs = written(pairs)
    known = bits(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    close = pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
    return written(close.select("a", "b", near(rule)("x", "n_a", "y", "n_b").alias("close")))


def hub_pairs(shared: DataFrame, rule: Rule) -> DataFrame:
    """The weightiest members of a group, of either half of the names, with all other members."""
    member = F.struct("weight", "node", "n", "at")
    odd = F.col("node") % 2 != 0
    hubs = shared.groupBy(*GROUP).agg(F.max(F.when(odd, member)).alias("x"), F.max(F.when(~odd, member)).alias("y"))
    # a table, so that the join after it has nothing but exchanges below and Spark may split a hot group's members
    hubs = written(hubs.select(*GROUP, F.explode(F.array("x", "y")).alias("o")).where("o IS NOT NULL"))
    return passing(shared.join(hubs, GROUP).where("node <> o.node"), rule)


def remaining_pairs(left: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members of a group that are in different components. A pair counts where its first shared shingle and its first shared band are."""
    rows = with_earlier(left)
    others = rows.select(*GROUP, F.struct("comp", "n", "node", "at", "low_band", "earlier").alias("o"))
    first_shared = ~F.arrays_overlap("earlier", "o.earlier") & (F.col("band") == F.greatest("low_band", "o.low_band"))
    return passing(rows.join(others, GROUP).where((F.col("comp") < F.col("o.comp")) & first_shared), rule)


def with_earlier(rows: DataFrame) -> DataFrame:
    """Adds a node's first shingles before this one, AHEAD of them at most, and its lower band. Most pairs that share several
    shingles share one of these, and are made once; the others are made more often, which `distinct` mends."""
    first = F.slice(F.array_sort(F.collect_set(F.struct("at", "token"))), 1, AHEAD)
    held = rows.groupBy("node").agg(first.alias("held"), F.min("band").alias("low_band"))
    return rows.join(held, "node").withColumn("earlier", F.transform(F.filter("held", lambda x: x["at"] < F.col("at")), lambda x: x["token"])).drop("held")


def merged(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The groups whose nodes are in several components, with these."""
    named = written(shared.join(components(links), "node", "left").select(*GROUP, "node", "n", "at", F.coalesce("root", "node").alias("comp")))
    return written(named.join(written(several(named, "comp")), GROUP, "left_semi"))


def one_of_each(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose id is the smallest of its component, all columns as they were. Rows that repeat an id stay or go
    together; rows without an id are numbered, so that each is a document of its own, after all others."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    doc_id = F.col(id_col).cast("long")
    rows = df.select(row, doc_id.alias("key"), F.col(text_col).alias("text"))
    numbered = F.monotonically_increasing_id() + F.lit(1 << 62)
    nameless = written(rows.where("key IS NULL").select("row", numbered.alias("key"), "text"))
    rows = rows.where("key IS NOT NULL").unionByName(nameless)
    stays = F.bool_or(F.col("doc_id") == F.col("component_id"))
    gone = written(join(rows, rule, "key", "text").groupBy(F.col("doc_id").alias("key")).agg(stays.alias("stays")).where("NOT stays").select("key"))
    return slots.without(rows.select("row", "key"), gone, "key").select(*[F.col(f"row.`{c}`") for c in df.columns])
