"""Scored vectors and spans, splits, and file round trips. Fixed linear heads over the embeddings stand for the scoring network."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.functions.python_udfs import round_half_even_6
from spanloom.operators import split as splits
from spanloom.operators.sampling import first_by_hash
from spanloom.plans.scoring import read
from spanloom.plans.text import lines, tokens_of
from spanloom.sources import files

CLASSES = 4
GAMMA, SMOOTHING = 2.0, 0.1
FLOOR = 0.9


def scores() -> Column:
    """Scores of the classes: the vector times small whole-number weights."""
    def score(c: int) -> Column:
        weighted = F.transform("embedding", lambda x, i: x.cast("double") * ((i * 7 + 13 * c) % 11 - 5))
        return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)

    return F.array(*[score(c) for c in range(CLASSES)])


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", spans.softmax(scores()).alias("p"))


SCORES = """
scored AS (SELECT vec_id, label, list_transform(range(0, 4), lambda c: list_sum(list_transform(range(0, len(embedding)), lambda i: embedding[i + 1]::double * ((i * 7 + 13 * c) % 11 - 5)))) AS s FROM embeddings),
weights AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS w FROM scored),
probs AS (SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM weights)
"""


def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_position("p", F.array_max("p")) - 1
    return probabilities(spark, sf_dir).select("vec_id", best.alias("class"), F.round(F.array_max("p"), 5).alias("confidence"))


def focal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean focal loss with label smoothing, per label; the target is the label modulo the classes."""
    p = probabilities(spark, sf_dir).withColumn("q", F.element_at("p", (F.col("label") % CLASSES + 1).cast("int")))
    smooth = F.aggregate(F.transform("p", lambda x: -F.log(x)), F.lit(0.0), lambda acc, x: acc + x) / CLASSES
    cross = -(1 - SMOOTHING) * F.log("q") + SMOOTHING * smooth
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(1 - F.col("q"), F.lit(GAMMA)) * cross), 6).alias("loss"))


def span_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise maximum and mean of each label's vectors, by place: partial aggregation instead of whole vectors in a group."""
    places = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return places.groupBy("label", "place").agg(F.max("x").cast("double").alias("most"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def scored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of up to three words with a confidence over the floor, and the island of overlapping spans that each lies in.

    Spans only compete within an island, so the greedy choice needs no whole line at once.
    """
    sized = lines(spark, sf_dir).select("doc_id", "line", F.size(tokens_of(F.col("content"))).alias("n")).where("n > 0")
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    full = starts.withColumn("end", F.explode(F.sequence("start", F.least(F.col("start") + 3, F.col("n")) - 1)))
    confidence = ((F.col("doc_id") * 31 + F.col("line") * 17 + F.col("start") * 7 + F.col("end") * 13) % 1000) / 1000
    kept = full.select("doc_id", "line", "start", "end", confidence.alias("confidence")).where(F.col("confidence") >= FLOOR)
    order = Window.partitionBy("doc_id", "line").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    return kept.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def selected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = F.struct((-F.col("confidence")).alias("k"), "start", "end")
    held = scored_spans(spark, sf_dir).groupBy("doc_id", "line", "island").agg(F.array_sort(F.collect_list(element)).alias("all"))
    return held.select("doc_id", "line", F.explode(spans.greedy_non_overlap(F.col("all"))).alias("s")).select("doc_id", "line", "s.start", "s.end", (-F.col("s.k")).alias("confidence"))


SPANS = f"""
toks AS (SELECT doc_id, line, len(list_filter(string_split(content, ' '), lambda x: x <> '')) AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL)),
begun AS (SELECT doc_id, line, n, unnest(range(0, n)) AS start FROM toks),
enumerated AS (SELECT doc_id, line, start, unnest(range(start, least(start + 3, n))) AS "end" FROM begun),
scored AS (SELECT *, ((doc_id * 31 + line * 17 + start * 7 + "end" * 13) % 1000) / 1000::double AS confidence FROM enumerated),
kept AS (SELECT * FROM scored WHERE confidence >= {FLOOR}::double),
marked AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY doc_id, line ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM kept),
islands AS (SELECT *, sum(fresh::int) OVER (PARTITION BY doc_id, line ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
lists AS (SELECT doc_id, line, island, list([{{'s': start, 'e': "end", 'c': confidence}}] ORDER BY confidence DESC, start, "end") AS l FROM islands GROUP BY ALL),
chosen AS (SELECT doc_id, line, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.s <= x[1].e AND x[1].s <= k.e)) > 0 THEN a ELSE a || x END)) AS s FROM lists)
"""


def greedy_span_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected_spans(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("start") * 3 + F.col("end")).alias("places"), F.round(F.sum("confidence"), 3).alias("confidence"))


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of different selected spans of a line, by the words between them."""
    found = selected_spans(spark, sf_dir).select("doc_id", "line", "start", "end")
    other = found.select("doc_id", "line", F.col("start").alias("s2"), F.col("end").alias("e2"))
    pairs = found.join(other, ["doc_id", "line"]).where("start <> s2 OR end <> e2")
    between = F.greatest(F.col("s2") - F.col("end"), F.col("start") - F.col("e2")) - 1
    return pairs.groupBy(F.least(between, F.lit(20)).alias("between")).agg(F.count(F.lit(1)).alias("n"))


def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each positive of a source, at least one, in the order of a seeded hash."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    hashed = rows.withColumn("h", F.md5(F.concat(F.col("doc_id"), F.lit("|negatives"))))
    wanted = rows.groupBy("source").agg(F.greatest(3 * F.count_if(F.col("toxic") == 1), F.lit(1)).alias("quota"))
    return first_by_hash(hashed.where("toxic = 0"), ["source"], "h", wanted).where("chosen").select("source", "doc_id")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A development share of 15 % of every stratum (language, quality, toxic), rounded, in the order of a seeded hash."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id").withColumn("h", F.md5(F.concat(F.col("doc_id"), F.lit("|split-42"))))
    stratum = ["lang", "quality", "toxic"]
    sizes = rows.groupBy(*stratum).agg(F.floor((F.count(F.lit(1)) * 15 + 50) / 100).alias("quota"))
    return first_by_hash(rows, stratum, "h", sizes).select("doc_id", F.when(F.col("chosen"), "development").otherwise("train").alias("split"))


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their label sets and a seeded rank."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    names = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in ("lang", "source", "quality", "toxic")]
    return rows.select(F.col("doc_id").alias("id"), F.array(*names).alias("labels"), F.md5(F.concat(F.lit("42|"), "doc_id")).alias("rank"))


def multilabel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 % of the labelled documents as development, the rarest label first: the fold of each. A sequence of choices has no SQL twin."""
    items = labelled_items(spark, sf_dir)
    return splits.multilabel_split(items, items.count() * 15 // 100, random.Random(42)).select(F.col("id").alias("doc_id"), F.col("fold").alias("split"))


def multilabel_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label in all and in either fold."""
    both = labelled_items(spark, sf_dir).join(multilabel_split(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")
    return both.select(F.explode("labels").alias("label"), "split").groupBy("label").agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("split") == f).alias(f) for f in splits.FOLDS])


def binary_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents predicted good: confusion, precision, recall, F1 and accuracy by language."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    p, g = F.col("n_chars") >= 1500, F.col("quality") == 1
    counts = rows.groupBy("lang").agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
    from spanloom.functions.metrics import binary_metrics, ratio_status

    return binary_metrics(counts).withColumn("status", ratio_status(F.col("tp") + F.col("fp")))


def label_threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of good and other documents at or above each length step, from one histogram and running sums."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    steps = rows.groupBy(F.least(F.floor(F.col("n_chars") / 500), F.lit(40)).alias("step")).agg(F.count_if(F.col("quality") == 1).alias("g"), F.count_if(F.col("quality") == 0).alias("b"))
    down = Window.orderBy(F.col("step").desc())  # 41 rows at most
    return steps.select("step", F.sum("g").over(down).alias("tp"), F.sum("b").over(down).alias("fp"))


def triple_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min(head, tail) * relation confidence, rounded as the binary value is; this rounding has no SQL twin."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.least("l_discount", "l_tax") * F.col("l_quantity") / 7).alias("c"))
    return rows.withColumn("c", round_half_even_6("c")).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c"), 4).alias("confidence"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as tab-separated text and scanned strictly."""
    table = read(spark, sf_dir, "supplier")
    path = files.scratch(spark)
    table.write.option("header", True).option("sep", "\t").csv(path)
    return files.strict_csv(spark, path, table.schema, "\t").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as JSON lines and scanned strictly."""
    table = read(spark, sf_dir, "nation")
    path = files.scratch(spark)
    table.write.option("ignoreNullFields", False).json(path)
    return files.strict_jsonl(spark, path, table.schema)


QUERIES = {
    f.__name__: f
    for f in (
        softmax_argmax, focal_loss, span_pooling, greedy_span_selection, span_pairs, negative_sampling, stratified_split, multilabel_split, multilabel_split_counts, binary_label_metrics,
        label_threshold_curve, triple_confidence, csv_round_trip, jsonl_round_trip,
    )
}

ORACLES = {
    "softmax_argmax": f"WITH {SCORES} SELECT vec_id, list_position(p, list_max(p)) - 1 AS class, round(list_max(p), 5) AS confidence FROM probs",
    "focal_loss": f"""WITH {SCORES}, q AS (SELECT label, p, p[label % 4 + 1] AS q FROM probs)
SELECT label, count(*) AS n, round(avg((1 - q) ** 2 * (-0.9::double * ln(q) + 0.1::double * list_sum(list_transform(p, lambda x: -ln(x))) / 4)), 6) AS loss FROM q GROUP BY label""",
    "span_pooling": """WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS place FROM embeddings)
SELECT label, place, max(x)::double AS most, round(avg(x::double), 6) AS mean FROM e GROUP BY ALL""",
    "greedy_span_selection": f"WITH {SPANS} SELECT doc_id, count(*) AS n_spans, sum(s.s * 3 + s.e)::bigint AS places, round(sum(s.c), 3) AS confidence FROM chosen GROUP BY doc_id",
    "span_pairs": f"""WITH {SPANS}, p AS (SELECT greatest(b.s.s - a.s.e, a.s.s - b.s.e) - 1 AS g FROM chosen a JOIN chosen b ON a.doc_id = b.doc_id AND a.line = b.line AND (a.s.s <> b.s.s OR a.s.e <> b.s.e))
SELECT least(g, 20) AS "between", count(*) AS n FROM p GROUP BY 1""",
    "negative_sampling": """WITH r AS (SELECT source, doc_id, toxic, md5(concat(doc_id, '|negatives')) AS h FROM labels JOIN documents USING (doc_id)),
w AS (SELECT source, greatest(3 * count(*) FILTER (WHERE toxic = 1), 1) AS wanted FROM r GROUP BY source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS place FROM r WHERE toxic = 0) SELECT n.source, doc_id FROM n JOIN w ON n.source = w.source WHERE place <= wanted""",
    "stratified_split": """WITH r AS (SELECT doc_id, lang, quality, toxic, md5(concat(doc_id, '|split-42')) AS h FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, quality, toxic ORDER BY h) AS place, (count(*) OVER (PARTITION BY lang, quality, toxic) * 15 + 50) // 100 AS quota FROM r)
SELECT doc_id, CASE WHEN place <= quota THEN 'development' ELSE 'train' END AS split FROM p""",
    "binary_label_metrics": """WITH c AS (SELECT lang, count(*) FILTER (WHERE n_chars >= 1500 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= 1500 AND quality = 0) AS fp,
 count(*) FILTER (WHERE n_chars < 1500 AND quality = 1) AS fn, count(*) FILTER (WHERE n_chars < 1500 AND quality = 0) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::double / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::double / (tp + fp + fn + tn) END AS accuracy,
 CASE WHEN tp + fp > 0 THEN 'defined' ELSE 'undefined_zero_denominator' END AS status FROM c""",
    "label_threshold_curve": """WITH s AS (SELECT least(n_chars // 500, 40) AS step, count(*) FILTER (WHERE quality = 1) AS g, count(*) FILTER (WHERE quality = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT step, (sum(g) OVER (ORDER BY step DESC))::bigint AS tp, (sum(b) OVER (ORDER BY step DESC))::bigint AS fp FROM s""",
    "csv_round_trip": "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY s_nationkey",
    "jsonl_round_trip": "SELECT * FROM nation",
}
