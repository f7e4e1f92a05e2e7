"""Requests, contracts between ledgers, and training inputs: payload identities, order and reference checks, padding and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.plans.scoring import read
from spanloom.plans.text import lines, tokens_of, words

PAD_TO = 8
SUBWORD = 4
STEPS, INITIAL, FINAL = 3500, 5.0, 1.0


def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request payloads with fields in a fixed order, their hash and the cache key of (mode, payload)."""
    body = F.concat(F.lit('{"model":"local","prompt":"order '), "o_orderkey", F.lit(" is "), "o_orderstatus", F.lit('","options":{"seed":42,"temperature":0}}'))
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", F.sha2(body, 256).alias("request"), F.sha2(F.concat(F.lit("simple|"), body), 256).alias("cache_key"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("request").alias("n_requests"), F.min("request").alias("first_request"), F.max("cache_key").alias("last_key"))


def parameter_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter lines grouped by name, names sorted, the values of a name in their order; how many texts become one."""
    line = F.concat(F.lit("stop "), "p_brand", F.lit("\ntemperature 0\nstop "), "p_type")
    turned = F.concat(F.lit("temperature 0\nstop "), "p_brand", F.lit("\nstop "), "p_type")
    texts = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, line).otherwise(turned).alias("text"))
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.substring_index(x, " ", 1).alias("name"), i.alias("i"), x.alias("line")))
    normal = F.array_join(F.transform(F.array_sort(parts), lambda x: x["line"]), "\n")
    return texts.groupBy(normal.alias("normal")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_written"))


def boost_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear decay over steps with a floor, averaged by thousands of steps."""
    step = F.col("o_orderkey") % 4000
    boost = F.greatest(F.lit(FINAL), F.lit(INITIAL) + F.lit(FINAL - INITIAL) * step / F.lit(float(STEPS)))
    return read(spark, sf_dir, "orders").groupBy(F.floor(step / 1000).alias("thousand")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(boost), 6).alias("boost"), F.round(F.min(boost), 6).alias("least"))


def pilot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each value of four verdict fields, nulls as 'null'."""
    fields = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "segment": F.when(F.col("o_custkey") % 5 > 0, (F.col("o_custkey") % 5).cast("string")), "large": (F.col("o_totalprice") > 200000).cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("null")).alias("value")) for k, v in fields.items()]))
    return read(spark, sf_dir, "orders").select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def subword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of words cut into pieces of four characters: the first piece carries the tag, the others -100."""
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.length("word") / SUBWORD).cast("int") - 1))
    label = F.when(F.col("piece") == 0, F.col("tag")).otherwise("-100")
    return words(spark, sf_dir).withColumn("piece", pieces).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines padded to multiples of eight words: kept and added places per document."""
    n = F.size(tokens_of(F.col("content")))
    sized = lines(spark, sf_dir).select("doc_id", n.cast("long").alias("n"))
    padded = F.ceil(F.col("n") / PAD_TO) * PAD_TO
    return sized.groupBy("doc_id").agg(F.sum("n").alias("places"), F.sum(padded - F.col("n")).alias("added"))


def resumed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded order of the examples, cut where a run had stopped: what is left, by label, and its first example."""
    rank = F.md5(F.concat(F.lit("42|"), F.col("vec_id")))
    left = read(spark, sf_dir, "embeddings").select("label", "vec_id", rank.alias("h")).where("h >= '66'")
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "vec_id"))["vec_id"].alias("next_example"))


def correction_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections against the line they cite: not asked for, unchanged, located once, ambiguous or not in the source."""
    held = lines(spark, sf_dir).select("line", tokens_of(F.col("content")).alias("w")).where(F.size("w") >= 6)
    fix = F.when(F.col("line") % 4 == 1, F.slice("w", 1, 2)).when(F.col("line") % 4 == 2, F.slice("w", 4, 2)).when(F.col("line") % 4 == 3, F.array(F.lit("no"), F.lit("~such~")))
    n = F.size(spans.locate_tokens(F.col("w"), F.col("fix")))
    status = (
        F.when(F.col("fix").isNull(), "not_applicable")
        .when(F.col("fix") == F.slice("w", 1, 2), "schema_invalid")
        .when(n > 1, "ambiguous")
        .when(n == 0, "out_of_source")
        .otherwise("source_valid")
    )
    return held.withColumn("fix", fix).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def ledger_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a customer's ledger that are dated before the row above them."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    seen = read(spark, sf_dir, "orders").withColumn("back", F.col("o_orderdate") < F.lag("o_orderdate").over(order))
    return seen.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("n_back")).where("n_back > 0")


def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key the other table lacks, in both directions of three contracts."""
    item, orders, customer = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    checks = (
        ("lineitem_order", item.select(F.col("l_orderkey").alias("k")), orders.select(F.col("o_orderkey").alias("k"))),
        ("order_lineitem", orders.select(F.col("o_orderkey").alias("k")), item.select(F.col("l_orderkey").alias("k"))),
        ("order_customer", orders.select(F.col("o_custkey").alias("k")), customer.select(F.col("c_custkey").alias("k"))),
        ("customer_order", customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))),
    )
    found = None
    for name, left, right in checks:
        one = left.join(right, "k", "left_anti").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("k").alias("n_keys")).withColumn("contract", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def field_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a field's rule; all rules in one pass."""
    rules = {
        "discount_in_unit": F.col("l_discount").between(0, 1),
        "quantity_positive": F.col("l_quantity") > 0,
        "known_flag": F.col("l_returnflag").isin("A", "N"),
        "tax_under_six_percent": F.col("l_tax") < F.lit(0.06),
        "line_in_range": F.col("l_linenumber").between(1, 6),
    }
    counts = read(spark, sf_dir, "lineitem").agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")


def receipt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded output hashes against the files there: matching, changed, and missing ones per producer."""
    there = read(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(F.concat_ws("|", "s_name", "s_nationkey"), 256).alias("now"))
    recorded = read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 23 == 4, 10**6).otherwise(0)).alias("s_suppkey"), (F.col("s_nationkey") % 4).alias("producer"),
        F.sha2(F.concat_ws("|", "s_name", F.col("s_nationkey") + F.when(F.col("s_suppkey") % 17 == 3, 1).otherwise(0)), 256).alias("then"))
    both = recorded.join(there, "s_suppkey", "left")
    return both.groupBy("producer").agg(F.count_if(F.col("now") == F.col("then")).alias("matching"), F.count_if(F.col("now") != F.col("then")).alias("changed"), F.count_if(F.col("now").isNull()).alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (
        request_records, parameter_normalization, boost_schedule, pilot_distribution, subword_labels, padding, resumed_order, correction_grounding, ledger_order_check,
        reference_check, field_violations, receipt_check,
    )
}

TOKENS = """
split_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, line, list_filter(string_split(content, ' '), lambda x: x <> '') AS w FROM split_lines)
"""

ORACLES = {
    "request_records": """WITH r AS (SELECT o_orderstatus, concat('{"model":"local","prompt":"order ', o_orderkey, ' is ', o_orderstatus, '","options":{"seed":42,"temperature":0}}') AS body FROM orders)
SELECT o_orderstatus, count(*) AS n, count(DISTINCT sha256(body)) AS n_requests, min(sha256(body)) AS first_request, max(sha256('simple|' || body)) AS last_key FROM r GROUP BY o_orderstatus""",
    "parameter_normalization": """WITH t AS (SELECT 'stop ' || p_brand || chr(10) || 'stop ' || p_type || chr(10) || 'temperature 0' AS normal, p_partkey % 2 AS side FROM part)
SELECT normal, count(*) AS n, count(DISTINCT side) AS n_written FROM t GROUP BY normal""",
    "boost_schedule": f"""WITH s AS (SELECT o_orderkey % 4000 AS step FROM orders), b AS (SELECT step, greatest({FINAL}::double, {INITIAL}::double + ({FINAL - INITIAL})::double * step / {STEPS}::double) AS boost FROM s)
SELECT step // 1000 AS thousand, count(*) AS n, round(avg(boost), 6) AS boost, round(min(boost), 6) AS least FROM b GROUP BY 1""",
    "pilot_distribution": """WITH f AS (SELECT unnest(['status', 'priority', 'segment', 'large']) AS field, unnest([o_orderstatus, o_orderpriority, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 5)::varchar END, (o_totalprice > 200000)::varchar]) AS value FROM orders)
SELECT field, coalesce(value, 'null') AS value, count(*) AS n FROM f GROUP BY ALL""",
    "subword_labels": f"""WITH {TOKENS}, w AS (SELECT unnest(w) AS word FROM tokens),
p AS (SELECT word, unnest(range(0, ceil(length(word) / {SUBWORD}.0)::bigint)) AS piece FROM w)
SELECT CASE WHEN piece > 0 THEN '-100' ELSE CASE length(word) % 6 WHEN 0 THEN 'B-object' WHEN 1 THEN 'I-object' WHEN 2 THEN 'B-property' WHEN 3 THEN 'I-property' ELSE 'O' END END AS label, count(*) AS n FROM p GROUP BY 1""",
    "padding": f"""WITH {TOKENS} SELECT doc_id, sum(len(w))::bigint AS places, sum((len(w) + {PAD_TO - 1}) // {PAD_TO} * {PAD_TO} - len(w))::bigint AS added FROM tokens GROUP BY doc_id""",
    "resumed_order": """WITH h AS (SELECT label, vec_id, md5('42|' || vec_id) AS h FROM embeddings) SELECT label, count(*) AS n, arg_min(vec_id, h) AS next_example FROM h WHERE h >= '66' GROUP BY label""",
    "correction_grounding": f"""WITH {TOKENS}, f AS (SELECT w, CASE line % 4 WHEN 1 THEN w[1:2] WHEN 2 THEN w[4:5] WHEN 3 THEN ['no', '~such~'] END AS fix FROM tokens WHERE len(w) >= 6),
c AS (SELECT *, len(list_filter(range(1, len(w)), lambda i: w[i:i+1] = fix)) AS n FROM f)
SELECT CASE WHEN fix IS NULL THEN 'not_applicable' WHEN fix = w[1:2] THEN 'schema_invalid' WHEN n > 1 THEN 'ambiguous' WHEN n = 0 THEN 'out_of_source' ELSE 'source_valid' END AS status, count(*) AS n FROM c GROUP BY 1""",
    "ledger_order_check": """WITH s AS (SELECT o_custkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders)
SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE back) AS n_back FROM s GROUP BY o_custkey HAVING count(*) FILTER (WHERE back) > 0""",
    "reference_check": """SELECT 'lineitem_order' AS contract, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_lineitem', count(*), count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'order_customer', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_order', count(*), count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "field_violations": """SELECT 'discount_in_unit' AS rule, count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 1) AS n FROM lineitem
UNION ALL SELECT 'quantity_positive', count(*) FILTER (WHERE NOT l_quantity > 0) FROM lineitem UNION ALL SELECT 'known_flag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'tax_under_six_percent', count(*) FILTER (WHERE NOT l_tax < 0.06::double) FROM lineitem UNION ALL SELECT 'line_in_range', count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 6) FROM lineitem""",
    "receipt_check": """WITH t AS (SELECT s_suppkey, sha256(concat_ws('|', s_name, s_nationkey)) AS now FROM supplier),
r AS (SELECT s_suppkey + CASE WHEN s_suppkey % 23 = 4 THEN 1000000 ELSE 0 END AS s_suppkey, s_nationkey % 4 AS producer, sha256(concat_ws('|', s_name, s_nationkey + CASE WHEN s_suppkey % 17 = 3 THEN 1 ELSE 0 END)) AS "then" FROM supplier)
SELECT producer, count(*) FILTER (WHERE now = "then") AS matching, count(*) FILTER (WHERE now <> "then") AS changed, count(*) FILTER (WHERE now IS NULL) AS missing FROM r LEFT JOIN t USING (s_suppkey) GROUP BY producer""",
}
