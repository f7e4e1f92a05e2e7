"""Checking candidates: customers stand for candidates, and their orders, in order of key, for the attempts to have each checked.

A customer's source is a sentence of its segment and name. What an attempt brings back follows from the order's key: timeouts,
refusals, bodies without JSON or message, content off the schema, and proper verdicts, some with corrections. Customers
without orders have no verdict, and orders may name customers that the candidates lack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import verdicts as ops
from spanloom.plans.scoring import read

ENTITY_TYPES = ("object", "property")
RELATIONS = ("part-of", "necessity")
#: What the model says, by the order's key modulo their number; {n} is the customer's name and {s} its segment.
CONTENTS = (
    '{"action":"KEEP","reason_code":"SUPPORTED","corrected":null}',
    '{"action":"DISCARD","reason_code":"UNSUPPORTED","corrected":null}',
    '{"action":"UNCERTAIN","reason_code":"AMBIGUOUS","corrected":null}',
    '{"action":"CORRECT","reason_code":"WRONG_TAIL","corrected":{"head_text":"{n}","head_type":"object","relation":"part-of","tail_text":"register","tail_type":"property"}}',
    '{"action":"CORRECT","reason_code":"WRONG_HEAD","corrected":{"head_text":"{s}","head_type":"object","relation":"part-of","tail_text":"register","tail_type":"property"}}',
    '{"action":"CORRECT","reason_code":"WRONG_HEAD","corrected":{"head_text":"nobody","head_type":"object","relation":"part-of","tail_text":"register","tail_type":"property"}}',
    '{"action":"CORRECT","reason_code":"WRONG_RELATION","corrected":{"head_text":"{n}","head_type":"object","relation":"necessity","tail_text":"the","tail_type":"property"}}',
    '{"action":"CORRECT","reason_code":"WRONG_TAIL","corrected":{"head_text":"{n}","head_type":"thing","relation":"part-of","tail_text":"register","tail_type":"property"}}',
    '{"action":"CORRECT","reason_code":"WRONG_TAIL","corrected":null}',
    '{"action":"KEEP","reason_code":"SUPPORTED","corrected":{"head_text":"{n}"}}',
    '{"action":"KEEP","reason_code":"SUPPORTED"}',
    '{"action":"MAYBE","reason_code":"SUPPORTED","corrected":null}',
    '["KEEP"]',
    "KEEP",
    "",
)
#: How many of every twenty orders time out, are refused, or come with a body that is no JSON or holds no message.
FATES = (("timeout", 3), ("refused", 4), ("no_json", 5), ("no_message", 6))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, training_seed, words, own) of the customers whose balance is not far below zero."""
    rows = read(spark, sf_dir, "customer").where("c_acctbal > -800")
    words = F.split(F.concat_ws(" ", F.lit("the"), "c_mktsegment", F.lit("register of"), "c_mktsegment", F.lit("holds"), "c_name"), " ")
    own = F.struct(F.col("c_name").alias("head_text"), F.lit("object").alias("head_type"), F.lit("necessity").alias("relation"), F.lit("the").alias("tail_text"), F.lit("property").alias("tail_type"))
    return rows.select(F.col("c_custkey").alias("candidate_id"), (42 + F.col("c_custkey") % 4).alias("training_seed"), words.alias("words"), own.alias("own"), "c_name", "c_mktsegment")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three orders of each candidate as attempts, with what they brought back."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), "o_orderkey", nth.alias("attempt")).where("attempt <= 3")
    held = orders.join(candidates(spark, sf_dir), "candidate_id")
    fate = F.col("o_orderkey") % 20
    texts = F.array(*[F.lit(c) for c in CONTENTS])
    content = F.replace(F.replace(F.element_at(texts, (F.col("o_orderkey") % len(CONTENTS) + 1).cast("int")), F.lit("{n}"), F.col("c_name")), F.lit("{s}"), F.col("c_mktsegment"))
    body = F.to_json(F.struct(F.struct(content.alias("content")).alias("message")))
    at = dict(FATES)
    return held.select(
        "candidate_id", "training_seed", "o_orderkey", "attempt", "words", "own",
        F.when(fate == at["timeout"], "timeout").otherwise("response").alias("transport_status"),
        F.when(fate == at["refused"], 503).otherwise(200).alias("http_status"),
        F.when(fate == at["no_json"], "<html>").when(fate == at["no_message"], '{"done":true}').otherwise(body).alias("raw"),
    )


def judged(spark: SparkSession, sf_dir: str, mode: str = "corrective") -> DataFrame:
    return ops.interpreted(attempts(spark, sf_dir), mode, list(ENTITY_TYPES), list(RELATIONS))


def attempt_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt's status, error, action and what became of its correction."""
    columns = ("o_orderkey", "attempt", "response_status", "error_category", "action", "reason_code", "correction_status")
    return judged(spark, sf_dir).select(*columns, F.col("fix.head_text").alias("fixed_head"))


def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per candidate in the saved form, with what it keeps and lets out."""
    found = ops.safe_emission(ops.final_verdicts(judged(spark, sf_dir), ["candidate_id"]))
    return found.select("candidate_id", "training_seed", F.col("n_attempts").alias("attempts"), "attempt", "response_status", "error_category", "action", "reason_code", "correction_status", "keeps", "emits")


def digest(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def verdict_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How candidates, verdicts and requests fit: every order is a verdict on its customer as it was asked, requests are one per
    customer with a known segment."""
    orders = read(spark, sf_dir, "orders")
    verdicts = orders.where("o_orderstatus <> 'O'").select(
        F.col("o_custkey").alias("candidate_id"), (42 + F.col("o_custkey") % 4).alias("training_seed"),
        digest(F.lit("check"), "o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", "now").otherwise("later")).alias("request_sha256"))
    requests = read(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("candidate_id"), (42 + F.when(F.col("c_nationkey") == 7, F.col("c_custkey") + 1).otherwise(F.col("c_custkey") % 4)).alias("training_seed"),
        digest(F.lit("check"), "c_custkey", F.lit("later")).alias("request_sha256"))
    found = ops.reconciled(candidates(spark, sf_dir), verdicts, requests)
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id"), F.sum("candidate_id").alias("ids"))


def verdict_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left-joined to the verdicts of two conditions: predicted valid, errors, and verdicts that are missing, per seed."""
    own = candidates(spark, sf_dir).select("candidate_id", "training_seed")
    rows = None
    for condition, mode in (("VER-SIMPLE", "simple"), ("VER-CORRECTIVE", "corrective")):
        said = ops.safe_emission(ops.final_verdicts(judged(spark, sf_dir, mode), ["candidate_id"])).select("candidate_id", "response_status", "keeps", "emits")
        both = own.join(said, "candidate_id", "left")
        part = both.groupBy("training_seed").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("response_status").isNull()).alias("n_missing"), F.count_if(F.col("response_status") != "valid_response").alias("n_failed"),
            F.count_if("keeps").alias("n_kept"), F.count_if("emits").alias("n_emitted")).withColumn("condition", F.lit(condition))
        rows = part if rows is None else rows.unionByName(part)
    return rows


QUERIES = {f.__name__: f for f in (attempt_interpretation, final_verdicts, verdict_reconciliation, verdict_coverage)}

_CASES = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CONTENTS))
_AT = dict(FATES)
CAND = """
cand AS (SELECT c_custkey AS candidate_id, 42 + c_custkey % 4 AS training_seed, c_name, c_mktsegment,
  string_split(concat_ws(' ', 'the', c_mktsegment, 'register of', c_mktsegment, 'holds', c_name), ' ') AS words FROM customer WHERE c_acctbal > -800)
"""


def _judged(mode: str, name: str) -> str:
    """The ladder of one mode over `tries`, as a relation."""
    keys = "['action', 'reason_code']" if mode == "simple" else "['action', 'corrected', 'reason_code']"
    actions = ", ".join(f"'{a}'" for a in ops.ACTIONS[mode])
    reasons = ", ".join(f"'{r}'" for r in ops.REASONS)
    fixed = "true" if mode == "simple" else "CASE WHEN a = 'CORRECT' THEN whole ELSE json_type(v, '$.corrected') = 'NULL' END"
    return f"""
{name}_a AS (SELECT *, list_sort(CASE WHEN kind = 'OBJECT' THEN json_keys(v) ELSE [] END) = {keys} AND coalesce(a IN ({actions}) AND r IN ({reasons}), false) AS shaped FROM said),
{name}_b AS (SELECT *, coalesce(shaped AND {fixed}, false) AS fine,
  CASE WHEN NOT shaped OR a <> 'CORRECT' OR {str(mode == "simple").lower()} THEN 'not_applicable' WHEN NOT whole THEN 'schema_invalid' WHEN n_head > 1 OR n_tail > 1 THEN 'ambiguous' WHEN n_head = 0 OR n_tail = 0 THEN 'out_of_source'
    WHEN f_head = c_name AND f_rel = 'necessity' AND f_tail = 'the' AND v->>'$.corrected.head_type' = 'object' AND v->>'$.corrected.tail_type' = 'property' THEN 'schema_invalid' ELSE 'valid' END AS fate2 FROM {name}_a),
{name} AS (SELECT candidate_id, training_seed, o_orderkey, attempt,
  CASE WHEN fate = {_AT['timeout']} THEN 'timeout_exhausted' WHEN fate = {_AT['refused']} THEN 'transport_exhausted' WHEN fate = {_AT['no_json']} THEN 'malformed' WHEN fate = {_AT['no_message']} OR content = '' THEN 'schema_invalid'
    WHEN NOT ok THEN 'malformed' WHEN NOT fine THEN 'schema_invalid' ELSE 'valid_response' END AS response_status,
  CASE WHEN fate = {_AT['timeout']} THEN 'timeout' WHEN fate = {_AT['refused']} THEN 'transport' WHEN fate = {_AT['no_json']} THEN 'non_json_http_response' WHEN fate = {_AT['no_message']} OR content = '' THEN 'missing_message_content'
    WHEN NOT ok THEN 'malformed' WHEN NOT fine THEN 'schema_invalid' END AS error_category,
  CASE WHEN response_status = 'valid_response' THEN a END AS action, CASE WHEN response_status = 'valid_response' THEN r END AS reason_code,
  CASE WHEN fate NOT IN ({', '.join(str(n) for _, n in FATES)}) AND content <> '' THEN fate2 END AS correction_status,
  CASE WHEN response_status = 'valid_response' AND fate2 = 'valid' THEN f_head END AS fixed_head FROM {name}_b),
{name}_final AS (
  SELECT *, count(*) OVER (PARTITION BY candidate_id) AS attempts, response_status = 'valid_response' AND action = 'KEEP' AS keeps,
    response_status = 'valid_response' AND (action = 'KEEP' OR (action = 'CORRECT' AND correction_status = 'valid')) AS emits FROM {name}
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN response_status = 'valid_response' THEN attempt END NULLS LAST, attempt DESC) = 1)"""


TRIES = f"""{CAND},
tries AS (
  SELECT c.*, o_orderkey, attempt, o_orderkey % 20 AS fate, replace(replace(CASE o_orderkey % {len(CONTENTS)} {_CASES} END, '{{n}}', c_name), '{{s}}', c_mktsegment) AS content
  FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt FROM orders) o JOIN cand c ON c.candidate_id = o_custkey WHERE attempt <= 3),
parsed AS (SELECT *, json_valid(content) AS ok, CASE WHEN json_valid(content) THEN content ELSE 'null' END::json AS v FROM tries),
named AS (SELECT *, json_type(v) AS kind, v->>'$.action' AS a, v->>'$.reason_code' AS r, v->>'$.corrected.head_text' AS f_head, v->>'$.corrected.tail_text' AS f_tail, v->>'$.corrected.relation' AS f_rel,
  v->>'$.corrected.head_type' AS h_type, v->>'$.corrected.tail_type' AS t_type FROM parsed),
said AS (SELECT *, coalesce(list_sort(json_keys(v, '$.corrected')) = ['head_text', 'head_type', 'relation', 'tail_text', 'tail_type'] AND h_type IN ('object', 'property') AND t_type IN ('object', 'property') AND f_rel IN ('part-of', 'necessity'), false) AS whole,
  len(list_filter(words, lambda x: x = f_head)) AS n_head, len(list_filter(words, lambda x: x = f_tail)) AS n_tail FROM named),
{_judged("corrective", "judged")},
{_judged("simple", "plain")}
"""

ORACLES = {
    "attempt_interpretation": f"WITH {TRIES} SELECT o_orderkey, attempt, response_status, error_category, action, reason_code, correction_status, fixed_head FROM judged",
    "final_verdicts": f"""WITH {TRIES} SELECT candidate_id, training_seed, attempts, attempt, response_status, error_category, action, reason_code, correction_status, coalesce(keeps, false) AS keeps, coalesce(emits, false) AS emits FROM judged_final""",
    "verdict_reconciliation": f"""WITH {CAND}, v AS (SELECT o_custkey AS id, count(*) AS n, min(sha256(concat_ws('|', 'check', o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE 'later' END))) AS sha FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
r AS (SELECT c_custkey AS id, sha256(concat_ws('|', 'check', c_custkey, 'later')) AS sha, 42 + CASE WHEN c_nationkey = 7 THEN c_custkey + 1 ELSE c_custkey % 4 END AS seed FROM customer WHERE c_mktsegment <> 'MACHINERY'),
s AS (SELECT coalesce(c.candidate_id, v.id) AS id, CASE WHEN c.candidate_id IS NULL THEN 'unknown_candidate' WHEN v.n > 1 THEN 'duplicate_verdict' WHEN v.n IS NULL THEN 'missing_verdict' WHEN r.id IS NULL THEN 'missing_request'
  WHEN r.sha <> v.sha THEN 'request_differs' WHEN training_seed <> r.seed THEN 'seed_differs' ELSE 'matched' END AS state FROM cand c FULL JOIN v ON v.id = c.candidate_id LEFT JOIN r ON r.id = coalesce(c.candidate_id, v.id))
SELECT state, count(*) AS n, min(id) AS first_id, sum(id)::bigint AS ids FROM s GROUP BY state""",
    "verdict_coverage": f"""WITH {TRIES}, b AS (SELECT 'VER-SIMPLE' AS condition, c.training_seed, response_status, keeps, emits FROM cand c LEFT JOIN plain_final p ON p.candidate_id = c.candidate_id
 UNION ALL SELECT 'VER-CORRECTIVE', c.training_seed, response_status, keeps, emits FROM cand c LEFT JOIN judged_final p ON p.candidate_id = c.candidate_id)
SELECT condition, training_seed, count(*) AS n, count(*) FILTER (WHERE response_status IS NULL) AS n_missing, count(*) FILTER (WHERE response_status <> 'valid_response') AS n_failed,
 count(*) FILTER (WHERE keeps) AS n_kept, count(*) FILTER (WHERE emits) AS n_emitted FROM b GROUP BY ALL""",
}
