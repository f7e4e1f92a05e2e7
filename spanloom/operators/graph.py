"""Retrieval over an edge table: seeds by substring or shared words, then hops in order of first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.files import saved

CAP = 15
GRAM = 4
QUESTION_CELLS = 1 << 25
#: Fixed value: what counts as white space between words, the separators of Unicode included.
SPACES = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, edge_pos, head, relation, tail): each distinct edge at its first place, under both lower-cased ends."""
    first = edges.groupBy("head", "relation", "tail").agg(F.min("edge_pos").alias("edge_pos"))
    ends = F.explode(F.array_distinct(F.array(F.lower("head"), F.lower("tail")))).alias("node")
    return first.select(ends, "edge_pos", "head", "relation", "tail")


def nodes(edges: DataFrame) -> DataFrame:
    """(node, node_pos) in order of first appearance, the head of an edge before its tail."""
    ends = F.explode(F.array(F.struct(F.lower("head").alias("node"), F.lit(0).alias("side")), F.struct(F.lower("tail").alias("node"), F.lit(1).alias("side"))))
    return edges.select("edge_pos", ends.alias("x")).groupBy("x.node").agg(F.min(F.col("edge_pos") * 2 + F.col("x.side")).alias("node_pos"))


def containing(short: DataFrame, whole: DataFrame, gram: int = GRAM) -> DataFrame:
    """(s, l) of the distinct strings `short`.s and `whole`.l where l contains s.

    A string can only lie in another that has all of its grams, so each is looked up by its rarest gram alone and then
    compared: an equi-join whose size is the rarest grams' and not that of all pairs. Strings shorter than a gram are their
    own gram, and every whole string is also cut to those lengths; the empty string, one row at most, lies in all.
    """
    short, whole = short.select("s").distinct(), whole.select("l").distinct()

    def cuts(column: str, n: int) -> Column:
        last = F.length(column) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(column), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = whole.select("l", F.explode(F.array_distinct(F.concat(*[cuts("l", n) for n in range(1, gram + 1)]))).alias("g"))
    own = F.when(F.length("s") < gram, F.array("s")).otherwise(F.array_distinct(cuts("s", gram)))
    asked = short.where("s <> ''").select("s", own.alias("own")).select("s", F.size("own").alias("n_own"), F.explode("own").alias("g"))
    often = asked.join(grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").groupBy("s", "n_own").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "g"))["g"].alias("g"))
    met = often.where("found = n_own").select("s", "g").join(grams, "g").where(F.col("l").contains(F.col("s"))).select("s", "l")
    # the empty string: an equi-join on what every string begins with, against one row at most
    return met.unionByName(whole.select(F.substring("l", 1, 0).alias("s"), "l").join(F.broadcast(short.where("s = ''")), "s").select("s", "l"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, SPACES), lambda w: w != ""))


def seeds(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """(q, node, node_pos, rule): nodes that contain the query or are contained in it; for queries without any, nodes that
    share at least max(1, n // 2) of its n distinct words. Both rules are equi-joins, on grams and on words."""
    asked, vertices = saved(queries.select("q", stripped(F.lower("q")).alias("k"))), saved(vertices)
    keys, names = asked.select("k").distinct(), vertices.select("node").distinct()
    inside = containing(keys.toDF("s"), names.toDF("l")).toDF("k", "node")
    around = containing(names.toDF("s"), keys.toDF("l")).toDF("node", "k").select("k", "node")
    near = saved(inside.unionByName(around).distinct())
    exact = asked.join(near, "k").join(vertices, "node").select("q", "node", "node_pos", F.lit("substring").alias("rule"))
    open_ = asked.join(near.select("k").distinct(), "k", "left_anti")
    need = F.greatest(F.lit(1), F.floor(F.size(distinct_words(F.col("k"))) / 2))
    shared = (
        open_.select("q", need.alias("need"), F.explode(distinct_words(F.col("k"))).alias("word"))
        .join(vertices.select("node", "node_pos", F.explode(distinct_words(F.col("node"))).alias("word")), "word")
        .groupBy("q", "node", "node_pos", "need")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= need")
    )
    return exact.unionByName(shared.select("q", "node", "node_pos", F.lit("words").alias("rule")))


def hop(found: DataFrame, edges: DataFrame, queries: DataFrame, hops: int = 1, cap: int = CAP) -> DataFrame:
    """(q, place, hop, head, relation, tail): the first `cap` facts of each query in order of discovery.

    A frontier's edges come in the order of (place in the frontier, edge); an edge seen before is skipped; the next frontier
    is the ends of newly seen edges, in order, that no frontier has held.
    """
    key = ["head", "relation", "tail"]
    adjacent = adjacency(edges)
    frontier = found.select("q", "node", F.col("node_pos").alias("f_pos"))
    if hops > 1:  # each is read by every later hop
        adjacent, frontier = saved(adjacent), saved(frontier)
    visited, seen = frontier.select("q", "node"), None
    for h in range(1, hops + 1):
        met = frontier.join(adjacent, "node").groupBy("q", *key).agg(F.min(F.struct("f_pos", "edge_pos")).alias("o"))
        if seen is not None:
            met = met.join(seen.select("q", *key), ["q", *key], "left_anti")
        fresh = met.select("q", F.lit(h).alias("hop"), "o.f_pos", "o.edge_pos", *key)
        fresh = saved(fresh) if h < hops else fresh
        seen = fresh if seen is None else seen.unionByName(fresh)
        if h < hops:
            order = Window.partitionBy("q").orderBy("f_pos", "edge_pos")
            placed = fresh.withColumn("nth", F.row_number().over(order))
            ends = F.explode(F.array(F.struct(F.lower("head").alias("node"), F.lit(0).alias("side")), F.struct(F.lower("tail").alias("node"), F.lit(1).alias("side"))))
            following = placed.select("q", "nth", ends.alias("x")).groupBy("q", "x.node").agg(F.min(F.col("nth") * 2 + F.col("x.side")).cast("long").alias("f_pos"))
            frontier = saved(following.join(visited, ["q", "node"], "left_anti"))
            visited = visited.unionByName(frontier.select("q", "node"))
    order = Window.partitionBy("q").orderBy("hop", "f_pos", "edge_pos")
    return seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("q", "place", "hop", *key)


def best_lines(questions: DataFrame, lines: DataFrame, top: int = 3, block: int = 512) -> DataFrame:
    """(q, doc_id, line, overlap, place): the lines that share most distinct words with each question; ties by (doc_id, line).

    `questions` (q, words) is a stated set: it is collected if it has at most `QUESTION_CELLS` cells of questions by distinct
    words. A task counts the shared words of its lines with all questions, `block` of them at a time, and hands on the `top`
    of each, so what is shuffled is questions times tasks and not every pair that shares a word. Larger sets meet the lines
    through an inverted index.
    """
    asked = questions.select("q", "words").where(F.size("words") > 0)
    size = asked.select(F.explode("words").alias("w")).agg(F.countDistinct("w")).first()[0] * asked.count()
    order = Window.partitionBy("q").orderBy(F.col("overlap").desc(), "doc_id", "line")
    if size <= QUESTION_CELLS:
        rows = asked.collect()
        found = lines.select("doc_id", "line", F.lower("content").alias("content")).mapInPandas(_counted([r.q for r in rows], [r.words for r in rows], top, block), f"q {questions.schema['q'].dataType.simpleString()}, doc_id long, line int, overlap long")
    else:
        held = lines.select("doc_id", "line", F.explode(distinct_words(F.lower("content"))).alias("w"))
        found = held.join(asked.select("q", F.explode("words").alias("w")), "w").groupBy("q", "doc_id", "line").agg(F.count(F.lit(1)).alias("overlap"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def _counted(names: list, words: list[list[str]], top: int, block: int):
    """pandas map over (doc_id, line, content): the best lines of the partition for each question."""
    import re

    import numpy as np
    import pandas as pd

    spaces = re.compile(SPACES)
    place = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}

    def run(batches):
        best = pd.DataFrame({"at": [], "doc_id": [], "line": [], "overlap": []}, dtype="int64")
        tables = []
        for first in range(0, len(words), block):
            table = np.zeros((len(place), min(block, len(words) - first)), np.uint16)
            for i, ws in enumerate(words[first : first + block]):
                table[[place[w] for w in ws], i] = 1
            tables.append(table)
        for batch in batches:
            held = [sorted({place[w] for w in spaces.split(text) if w in place}) if text else [] for text in batch["content"].tolist()]
            rows = np.flatnonzero([len(h) for h in held])
            for cut in range(0, len(rows), 2048):
                part = rows[cut : cut + 2048]
                flat = np.concatenate([held[i] for i in part])
                begins = np.cumsum([0, *[len(held[i]) for i in part[:-1]]])
                fresh = [best]
                for nth, table in enumerate(tables):
                    overlap = np.add.reduceat(table[flat], begins, axis=0)  # lines by questions
                    least = -np.partition(-overlap.astype(np.int32), min(top, len(part)) - 1, axis=0)[min(top, len(part)) - 1]
                    line, question = np.nonzero((overlap >= np.maximum(least, 1)))
                    fresh.append(pd.DataFrame({"at": question + nth * block, "doc_id": batch["doc_id"].to_numpy()[part[line]], "line": batch["line"].to_numpy()[part[line]], "overlap": overlap[line, question].astype(np.int64)}))
                every = pd.concat(fresh).sort_values(["at", "overlap", "doc_id", "line"], ascending=[True, False, True, True])
                best = every.groupby("at", sort=False).head(top)
        yield pd.DataFrame({"q": [names[i] for i in best["at"]], "doc_id": best["doc_id"], "line": best["line"].astype("int32"), "overlap": best["overlap"]})

    return run
