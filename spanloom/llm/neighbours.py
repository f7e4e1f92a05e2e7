"""Approximate nearest neighbours by cosine: a graph built by neighbour descent, and greedy search in it.

Equal vectors are one node; a node stands for all its rows, of which no answer needs more than the first few by id. The graph
holds for every node the `k` nearest nodes found so far. It starts from random hyperplanes: nodes on the same side of all of
them share a leaf, and each is compared with its leaf. Then rounds of descent: every node is a meeting place where the nodes
that it points to, and a sample of those that point to it, are compared with each other, as far as one of the two is new
there; a pair better than the worst that one of them has goes to that one, and the best `k` stay. The rounds end when fewer
than `least_change` of the edges are new.

A round is joins and exchanges of bounded groups: at most k + reverse + 1 nodes meet, each with its vector as 8-bit codes (64
bytes for 64 dimensions); a node hands on at most `offers` pairs from a meeting. A node that many point to meets at each of
theirs, and its own meeting sees a sample of them, by hash; that loses no edge that is there, since lists are only improved.

A search keeps for each query a beam of the `beam` nearest nodes seen. All its nodes that have not been looked at yet send the
query's codes to their place in the graph (a table bucketed by node, which therefore never moves), compare it with their
neighbours there, and send back those that are nearer than the worst of a full beam. It ends when a beam's nodes have all been
looked at. The nearest of the beam by codes are then scored on the original vectors in double precision, all of them.

Approximate is only which nodes are seen; scores are exact, and all rows are indexed. Recall is measured against brute force in
the tests; the README has figures.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries neither;
nor do rows without an id. Vectors of another length are never neighbours. Of rows that repeat an id each takes part; a query
leaves out its own row, once. Ties go to the smaller id. With fewer candidates than asked for all are given. An empty table
gives no rows; other columns are not looked at and may have any names. Copies of a vector by the million are one node.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import dropped, removed, shared_dir, written


@dataclass(frozen=True)
class Shape:
    """Edges of a node, reverse edges that meet at it, pairs a node hands on from a meeting, rounds at most, share of new edges
    that ends them, rows of a leaf, sets of hyperplanes, width of a beam, steps of a search at most, and of the random draws the seed."""

    k: int = 24
    reverse: int = 16
    offers: int = 8
    rounds: int = 12
    least_change: float = 0.05
    leaf: int = 256
    planes: int = 2
    beam: int = 256
    steps: int = 64
    seed: int = 11


def usable(values: np.ndarray) -> bool:
    return len(values) > 0 and bool(np.isfinite(values).all()) and bool(values.any())


def encoded(values: np.ndarray) -> np.ndarray:
    """8-bit codes of a vector's direction."""
    return np.round(values * (127.0 / np.abs(values).max())).astype(np.int8)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (id, vector as doubles) to (id, vector, code), of the vectors that take part."""
    for batch in batches:
        ids, kept, codes = [], [], []
        for i, (id_, vector) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            if id_ is None or not vector.is_valid or vector.values.null_count:
                continue
            values = vector.values.to_numpy(zero_copy_only=False)
            if usable(values):
                ids.append(id_)
                kept.append(i)
                codes.append(encoded(values).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(1).take(pa.array(kept, pa.int64())), pa.array(codes, pa.binary())], ["id", "vector", "code"])


def unit(codes: np.ndarray) -> np.ndarray:
    """1 / length of each row of codes."""
    return (1.0 / np.sqrt((codes * codes).sum(axis=-1))).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a binary column of equal lengths, as numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of a binary column have one length in each."""
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(column).to_pylist()])
        for size in np.unique(sizes):
            yield batch.filter(pa.array(sizes == size)) if len(np.unique(sizes)) > 1 else batch


def leaves(bits: int, shape: Shape):
    """Arrow map over (node, code): (node, plane, leaf, code), a row for each set of hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_length(batches, "code"):
            x = matrix(batch.column("code"))
            for plane in range(shape.planes):
                normals = np.random.default_rng([shape.seed, plane, x.shape[1]]).normal(size=(x.shape[1], bits)).astype(np.float32)
                side = ((x @ normals) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.full(len(x), plane), pa.int32()), pa.array(side.astype(np.int64)), batch.column("code")], ["node", "plane", "leaf", "code"])

    return run


EDGES = "node long, nbr long, sim float"


def edges_of(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(sim, pa.float32())], ["node", "nbr", "sim"])


def within_leaf(k: int):
    """Grouped Arrow map over a leaf's rows: the k best of the leaf for each."""

    def run(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        x = matrix(rows.column("code").combine_chunks())
        most = min(k, len(node) - 1)
        if most < 1:
            return pa.Table.from_batches([edges_of(node[:0], node[:0], np.zeros(0))])
        scale = unit(x)
        out = []
        for at in range(0, len(node), 512):
            sim = (x[at : at + 512] @ x.T) * scale * scale[at : at + 512, None]
            sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -9
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            out.append(edges_of(np.repeat(node[at : at + 512], most), node[best].ravel(), np.take_along_axis(sim, best, 1).ravel()))
        return pa.Table.from_batches(out)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about so many rows of batches that are sorted by a key; no key's rows are in two tables."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def meet(shape: Shape):
    """Arrow map over rows (place, node, new, code, worst), sorted by place: EDGES that are better than the worst a node has.

    Of a place's nodes those are compared of which one is new there. Each hands on its best `offers`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "place"):
            place = table.column("place").to_numpy()
            sizes = np.array([len(c) for c in table.column("code").to_pylist()])
            for size in np.unique(sizes):
                yield from compared(table.filter(pa.array(sizes == size)) if (sizes != size).any() else table, place[sizes == size])

    def compared(table: pa.Table, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, new, worst = (table.column(c).to_numpy() for c in ("node", "new", "worst"))
        x = matrix(table.column("code").combine_chunks())
        scale = unit(x)
        firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        counts = np.diff(np.append(firsts, len(place)))
        for at in range(0, len(firsts), 128):
            n = counts[at : at + 128]
            wide = np.arange(n.max())
            there = wide < n[:, None]
            i = np.where(there, firsts[at : at + 128, None] + wide, 0)
            sim = x[i] @ x[i].transpose(0, 2, 1) * scale[i][:, :, None] * scale[i][:, None, :]
            ids = node[i]
            ok = there[:, :, None] & there[:, None, :] & (new[i][:, :, None] | new[i][:, None, :]) & (ids[:, :, None] != ids[:, None, :])
            sim[~(ok & (sim > worst[i][:, :, None]))] = -9
            most = min(shape.offers, sim.shape[2])
            best = np.argpartition(-sim, most - 1, axis=2)[:, :, :most]
            value = np.take_along_axis(sim, best, 2)
            other = np.take_along_axis(np.broadcast_to(ids[:, None, :], sim.shape), best, 2)
            told = value > -2
            yield edges_of(np.broadcast_to(ids[:, :, None], told.shape)[told], other[told], value[told])

    return run


def best(edges: DataFrame, by: str, of: str, most: int, flag: str) -> DataFrame:
    """The `most` best rows of each `by`, (by, of) once; `flag` is of the row that was there before."""
    one = edges.repartition(by).groupBy(by, of).agg(F.max("sim").alias("sim"), F.min(flag).alias(flag))
    order = Window.partitionBy(by).orderBy(F.col("sim").desc(), of)
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


@dataclass
class Index:
    """nodes (node, vector, code), copies (node, id: the first rows of each node), graph (node, nbr, sim), and what built it."""

    nodes: DataFrame
    copies: DataFrame
    graph: DataFrame
    shape: Shape


def build(df: DataFrame, shape: Shape = Shape(), id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 6) -> Index:
    """The graph over all rows of `df`; `copies`: how many rows of a node an answer may need."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(encode, "id long, vector array<double>, code binary")
    order = Window.partitionBy("vector").orderBy("id")
    first = written(rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= copies))
    # ids of nodes are fixed by being written
    nodes = written(first.where("at = 1").select(F.monotonically_increasing_id().alias("node"), "id", "vector", "code"))
    held = written(first.join(nodes.select("node", "vector"), "vector").select("node", "id"))
    dropped(first)
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / shape.leaf))))
    planes = nodes.select("node", "code").mapInArrow(leaves(bits, shape), "node long, plane int, leaf long, code binary").withColumn("dims", F.length("code"))
    leaf = ["plane", "dims", "leaf"]
    parts = planes.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / (2.0 * shape.leaf)).alias("parts"))
    dealt = planes.join(parts, leaf).withColumn("part", F.pmod(F.xxhash64("node", "plane"), F.col("parts"))).drop("parts")
    start = dealt.groupBy(*leaf, "part").applyInArrow(within_leaf(shape.k), EDGES).withColumn("new", F.lit(True))
    graph = written(best(start, "node", "nbr", shape.k, "new"))
    codes = nodes.select("node", "code")
    for turn in range(shape.rounds):
        changed = graph.agg(F.count_if("new"), F.count(F.lit(1))).first()
        if changed[0] <= shape.least_change * changed[1]:
            break
        worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= shape.k, F.min("sim")).otherwise(-2.0).cast("float").alias("worst"))
        known = codes.join(worst, "node", "left").select("node", "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        there = graph.select(F.col("node").alias("place"), F.col("nbr").alias("node"), "new")
        back = graph.select(F.col("nbr").alias("place"), "node", "new")
        sample = Window.partitionBy("place").orderBy(F.col("new").desc(), F.xxhash64("node", "place", F.lit(turn)))
        back = back.withColumn("at", F.row_number().over(sample)).where(F.col("at") <= shape.reverse).drop("at")
        own = codes.select(F.col("node").alias("place"), "node", F.lit(False).alias("new"))
        meeting = there.unionByName(back).unionByName(own).join(known, "node").select("place", "node", "new", "code", "worst")
        found = meeting.repartition("place").sortWithinPartitions("place").mapInArrow(meet(shape), EDGES).withColumn("new", F.lit(True))
        following = written(best(graph.withColumn("new", F.lit(False)).unionByName(found), "node", "nbr", shape.k, "new"))
        dropped(graph)
        graph = following
    return Index(nodes, held, graph, shape)


def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (query, code, worst, nbrs, codes): (query, node, sim) of a place's neighbours that are nearer than the worst."""
    for batch in batches:
        query, node, sim = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("query", "code", "worst", "nbrs", "codes"))
        for q, code, worst, nbrs, codes in zip(*columns, strict=True):
            x = np.frombuffer(codes, np.int8).reshape(len(nbrs), -1).astype(np.float32)
            c = np.frombuffer(code, np.int8).astype(np.float32)
            if x.shape[1] != len(c):
                continue
            s = (x @ c) * unit(x) * unit(c[None])[0]
            ok = s > worst
            query.append(np.full(int(ok.sum()), q))
            node.append(np.array(nbrs, np.int64)[ok])
            sim.append(s[ok])
        if query:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in ((query, pa.int64()), (node, pa.int64()), (sim, pa.float32()))], ["query", "node", "sim"])


def by_node(index: Index) -> tuple[str, str]:
    """The graph as a table bucketed by node, with the codes of the neighbours beside their names: its name and its path."""
    spark = index.nodes.sparkSession
    edge = F.struct(F.col("nbr"), F.col("code"))
    held = index.graph.join(index.nodes.select(F.col("node").alias("nbr"), "code"), "nbr").groupBy("node").agg(F.collect_list(edge).alias("e"))
    codes = F.aggregate("e.code", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))
    name = f"spanloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = held.select("node", F.col("e.nbr").alias("nbrs"), codes.alias("codes"))
    table.repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).option("compression", "zstd").saveAsTable(name)
    return name, path


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(query, node, sim) of the beams in which the searches for `queries` (query, code, entry: a node to begin at) end."""
    spark, shape = index.nodes.sparkSession, index.shape
    codes = written(queries.select("query", "code").dropDuplicates(["query"]))
    name, path = by_node(index)
    beams = written(queries.select("query", F.col("entry").alias("node"), F.lit(-2.0).cast("float").alias("sim"), F.lit(1).alias("fresh")))
    for _ in range(shape.steps):
        full = Window.partitionBy("query")
        worst = F.when(F.count(F.lit(1)).over(full) >= shape.beam, F.min("sim").over(full)).otherwise(F.lit(-2.0).cast("float"))
        at = beams.withColumn("worst", worst).where("fresh = 1").join(codes, "query").select("node", "query", "code", "worst")
        found = at.join(spark.table(name), "node").select("query", "code", "worst", "nbrs", "codes").mapInArrow(look, "query long, node long, sim float")
        following = beams.withColumn("fresh", F.lit(0)).unionByName(found.withColumn("fresh", F.lit(1)))
        following = written(best(following, "query", "node", shape.beam, "fresh"))
        dropped(beams)
        beams = following
        if beams.where("fresh = 1").isEmpty():
            break
    spark.sql(f"DROP TABLE {name}")
    removed(spark, path)
    dropped(codes)
    return beams.select("query", "node", "sim")


def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map over (query, node, a, b), vectors of doubles of one length: (query, node, score), their cosine."""
    for batch in batches:
        scores = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, y = (v.values.to_numpy(zero_copy_only=False) for v in (a, b))
            # by powers of two: no rounding, and no squares out of range
            x, y = (np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in (x, y))
            scores.append(float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(scores, pa.float64())], ["query", "node", "score"])


def nearest(df: DataFrame, every: int = 50, answers: int = 5, shape: Shape = Shape(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row whose id is divisible by `every`."""
    index = build(df, shape, id_col, vector_col, answers + 1)
    # all rows that ask, and the node that each is at; equal vectors search once
    asked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id") % every == 0)
    asked = written(asked.join(index.nodes.select("node", "vector", "code"), "vector").select("id", "node", "code"))
    begin = asked.select(F.col("node").alias("query"), "code", F.col("node").alias("entry")).dropDuplicates(["query"])
    beams = written(search(index, begin))
    own = begin.select("query", F.col("query").alias("node"))
    nodes = index.nodes.select("node", "vector")
    pairs = beams.select("query", "node").unionByName(own).distinct()
    pairs = pairs.join(nodes.withColumnRenamed("vector", "b"), "node").join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("a")), "query")
    scored = pairs.where(F.size("a") == F.size("b")).select("query", "node", "a", "b").mapInArrow(cosines, "query long, node long, score double")
    # a node's nearest rows: all that may be among the answers for one of its rows
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    rows = scored.join(index.copies, "node").withColumn("at", F.row_number().over(order)).where(F.col("at") <= answers + 1)
    met = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).withColumn("ask", F.monotonically_increasing_id())
    met = met.join(rows, "query")
    # of the rows of the query's own node that have its id, one is itself
    mine = (F.col("query") == F.col("node")) & (F.col("id") == F.col("query_id"))
    by = Window.partitionBy("ask")
    met = met.withColumn("self", F.min(F.when(mine, F.col("at"))).over(by)).where(F.col("self").isNull() | (F.col("at") != F.col("self")))
    met = met.withColumn("rank", F.row_number().over(by.orderBy("at"))).where(F.col("rank") <= answers)
    out = written(met.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
    dropped(beams, asked, index.nodes, index.copies, index.graph)
    return out
