"""States of spans and between spans. Forty embeddings in order of id stand for the token states of a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import pooling
from spanloom.plans.scoring import read
from spanloom.sources.files import saved

WORDS, WIDEST, DIM = 40, 8, 64


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.floor(F.col("vec_id") / WORDS).alias("sentence"), (F.col("vec_id") % WORDS).alias("at"), F.col("embedding").alias("state"))


def spans(held: DataFrame) -> DataFrame:
    """All spans of up to eight words."""
    sizes = held.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))
    begun = sizes.select("sentence", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    return begun.select("sentence", "start", F.explode(F.sequence("start", F.least(F.col("start") + WIDEST, F.col("n")) - 1)).alias("end"))


def weighed(state: Column) -> Column:
    """One number that depends on every place of a state."""
    return F.aggregate(F.transform(state, lambda x, i: x * (i % 7 + 1)), F.lit(0.0), lambda a, x: a + x)


def span_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and greatest states of every span."""
    tokens = states(spark, sf_dir)
    found = pooling.span_states(pooling.ranges(tokens, DIM, WIDEST), spans(tokens))
    part = [F.slice("state", 1 + DIM * i, DIM) for i in range(3)]
    return found.select("sentence", "start", "end", F.size("state").alias("n"), *[F.round(weighed(p), 4).alias(name) for p, name in zip(part, ("first", "last", "most"), strict=True)])


def between_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean states between the ordered pairs of a sentence's chosen spans."""
    tokens = states(spark, sf_dir)
    held = saved(pooling.ranges(tokens, DIM, 1))
    chosen = spans(tokens).where("(start * 3 + end + sentence) % 11 = 0")
    left, right = chosen.toDF("sentence", "s1", "e1"), chosen.toDF("sentence", "s2", "e2")
    pairs = left.join(right, "sentence").where("s1 <> s2 OR e1 <> e2")
    return pooling.between_states(held, pairs, DIM).select("sentence", "s1", "e1", "s2", "e2", F.round(weighed(F.col("state")), 4).alias("mean"))


QUERIES = {"span_states": span_states, "between_states": between_states}

TOKENS = f"""
tok AS (SELECT vec_id // {WORDS} AS sentence, vec_id % {WORDS} AS "at", embedding::DOUBLE[] AS state FROM embeddings WHERE embedding IS NOT NULL),
sized AS (SELECT sentence, count(*) AS n FROM tok GROUP BY sentence),
begun AS (SELECT sentence, n, unnest(range(0, n)) AS start FROM sized),
spans AS (SELECT sentence, start, unnest(range(start, least(start + {WIDEST}, n))) AS "end" FROM begun),
places AS (SELECT sentence, "at", unnest(state) AS x, unnest(range(0, {DIM})) AS i FROM tok)
"""

ORACLES = {
    "span_states": f"""WITH {TOKENS}, m AS (SELECT s.sentence, start, "end", i, max(x) AS most, max(x) FILTER (WHERE "at" = start) AS first, max(x) FILTER (WHERE "at" = "end") AS last
 FROM spans s JOIN places p ON p.sentence = s.sentence AND "at" BETWEEN start AND "end" GROUP BY ALL)
SELECT sentence, start, "end", {3 * DIM} AS n, round(sum(first * (i % 7 + 1)), 4) AS first, round(sum(last * (i % 7 + 1)), 4) AS last, round(sum(most * (i % 7 + 1)), 4) AS most FROM m GROUP BY sentence, start, "end\"""",
    "between_states": f"""WITH {TOKENS}, chosen AS (SELECT * FROM spans WHERE (start * 3 + "end" + sentence) % 11 = 0),
pairs AS (SELECT a.sentence, a.start AS s1, a."end" AS e1, b.start AS s2, b."end" AS e2 FROM chosen a JOIN chosen b ON a.sentence = b.sentence AND (a.start <> b.start OR a."end" <> b."end")),
w AS (SELECT sentence, "at", sum(x * (i % 7 + 1)) AS x FROM places GROUP BY ALL)
SELECT p.*, round(coalesce(avg(x), 0), 4) AS mean FROM pairs p LEFT JOIN w ON w.sentence = p.sentence AND "at" > least(e1, e2) AND "at" < greatest(s1, s2) GROUP BY ALL""",
}
