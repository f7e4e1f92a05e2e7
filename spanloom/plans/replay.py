"""Replay of saved ledgers, and the gate of a pilot: what was recorded against what is computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import checks, hash_tree, nested
from spanloom.operators import verdicts as ops
from spanloom.plans import journal, scoring, verdicts
from spanloom.plans.scoring import read
from spanloom.sources import files

COLUMNS = ("seed", "candidate_id", "example_id", "doc", "confidence", "pick")


def recorded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate ledger as a run saved it, with faults: lost rows, another confidence, a row of an id that no candidate has."""
    rows = scoring.keyed(scoring.candidates(spark, sf_dir)).select(*COLUMNS)
    place = F.pmod(F.col("example_id") * 7 + F.col("seed"), F.lit(101))
    kept = rows.where(place != 3).withColumn("confidence", F.when(place == 5, F.col("confidence") + 0.5).otherwise(F.col("confidence")))
    extra = rows.where(place == 9).withColumn("candidate_id", F.concat(F.lit("unknown-"), F.col("example_id").cast("string")))
    path = files.scratch(spark)
    kept.unionByName(extra).write.json(path, compression="gzip")
    return spark.read.schema(rows.schema).json(path)


def candidate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates computed again against the saved ledger: ids that the ledger lacks, has too many, or tells otherwise."""
    again = scoring.keyed(scoring.candidates(spark, sf_dir)).select(*COLUMNS)
    return hash_tree.differences(again, recorded_candidates(spark, sf_dir), ["seed", "candidate_id"])


def verdict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, candidate_id, status1, status2, verdict1, verdict2, safe, emitted): final verdicts of both modes, twice. The second
    corrective call says otherwise of every 17th candidate, and lets out every 19th whatever was said."""
    both = None
    for mode in ("simple", "corrective"):
        said = ops.safe_emission(ops.final_verdicts(verdicts.judged(spark, sf_dir, mode), ["candidate_id"]))
        other = (F.lit(mode) == "corrective") & (F.col("candidate_id") % 17 == 4)
        rows = said.select(
            F.lit(mode).alias("mode"), "candidate_id", F.col("response_status").alias("status1"), F.col("response_status").alias("status2"), F.col("action").alias("verdict1"),
            F.when(other, "KEPT").otherwise(F.col("action")).alias("verdict2"), F.coalesce("emits", F.lit(False)).alias("safe"),
            (F.coalesce("emits", F.lit(False)) | ((F.lit(mode) == "corrective") & (F.col("candidate_id") % 19 == 6))).alias("emitted"))
        both = rows if both is None else both.unionByName(rows)
    return both


def pilot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen checks over customers as candidates, their checked orders as verdicts and events as calls."""
    pairs = files.saved(verdict_pairs(spark, sf_dir))
    customers = read(spark, sf_dir, "customer")
    asked = pairs.where("mode = 'corrective'").select("candidate_id")
    pilot = customers.select(F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_nationkey") == 24, "train").otherwise("development").alias("split"), (F.col("c_mktsegment") != "MACHINERY").alias("has_gold")).join(asked, "candidate_id", "left_semi")
    started = F.unix_micros(F.col("ts").cast("timestamp"))
    ended = started + F.round(F.col("value") * 1e6).cast("long")
    order = Window.partitionBy("user_id", "day", "request").orderBy("attempt")
    calls = journal.attempts(spark, sf_dir).select(
        F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 997 != 5, "run-1").alias("run_id"), F.lit("run-1").alias("expected_run"), started.alias("started"),
        F.lit(0).cast("long").alias("declared"), "attempt", ((started - F.lag(ended).over(order)) / 1e6).alias("waited"), (F.col("event_type") == "click").alias("cached"), F.json_object_keys("props").alias("fields"))
    written = F.sum(F.crc32(F.concat_ws("|", "candidate_id", "verdict1"))), F.sum(F.crc32(F.concat_ws("|", "candidate_id", "verdict2")))
    ledgers = pairs.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), *[w.alias(f"f{i}") for i, w in enumerate(written, 1)])
    ledgers = ledgers.select("mode", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("repeat"), F.col(f"f{i}").cast("string").alias("identity")) for i in (1, 2)])).alias("x")).select("mode", "x.repeat", "x.identity", "n")
    return checks.pilot_gate(
        {
            "index": scoring.candidates(spark, sf_dir).select(F.col("example_id").alias("candidate_id"), "seed"), "pilot": pilot, "calls": calls, "ledgers": ledgers, "pairs": pairs,
            "emissions": pairs.where("mode = 'corrective'"), "settings": read(spark, sf_dir, "region").agg((F.count(F.lit(1)) / 10).alias("selected"), F.lit(0.5).alias("recorded")),
        },
        ("k",),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, own, body): receipts in JSON, two to seven levels deep; some name the run of another receipt somewhere in them."""
    key = F.col("o_orderkey")
    run = F.concat(F.lit("run-"), (key % 9).cast("string"))
    deep = F.concat(F.lit('{"run_id":"run-'), F.when(key % 17 == 3, 9).otherwise(key % 9).cast("string"), F.lit('","status":"'), "o_orderstatus", F.lit('","n":'), "o_custkey", F.lit("}"))
    for level in range(5):  # a level more for each that the key asks for
        deep = F.when(key % 6 > level, F.concat(F.lit('{"inputs":[null,{"parent":'), deep, F.lit('}],"note":{}}'))).otherwise(deep)
    listed = F.when(key % 29 == 5, F.lit('["run-4",{"run_id":["run-x",null]}]')).otherwise(F.lit("[]"))
    body = F.concat(F.lit('{"run_id":"'), run, F.lit('","lineage":'), deep, F.lit(',"others":'), listed, F.lit("}"))
    return read(spark, sf_dir, "orders").select(key.alias("order_id"), run.alias("own"), body.alias("body"))


def foreign_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where receipts name a run that is not theirs, at any depth; the shape of a receipt is not told."""
    return nested.foreign(receipts(spark, sf_dir).withColumn("body", F.parse_json("body")), "order_id", "body", "own")


QUERIES = {f.__name__: f for f in (candidate_replay, pilot_gate, foreign_runs)}

_DEEP = """concat('{"run_id":"run-', CASE WHEN o_orderkey % 17 = 3 THEN 9 ELSE o_orderkey % 9 END, '","status":"', o_orderstatus, '","n":', o_custkey, '}')"""
for _level in range(5):
    _DEEP = f"""CASE WHEN o_orderkey % 6 > {_level} THEN concat('{{"inputs":[null,{{"parent":', {_DEEP}, '}}],"note":{{}}}}') ELSE {_DEEP} END"""

ORACLES = {
    "candidate_replay": f"""WITH {scoring.KEYED}, again AS (SELECT seed, candidate_id, example_id, doc, confidence, pick FROM keyed),
saved AS (
 SELECT seed, candidate_id, example_id, doc, confidence + CASE WHEN (example_id * 7 + seed) % 101 = 5 THEN 0.5 ELSE 0 END AS confidence, pick FROM again WHERE (example_id * 7 + seed) % 101 <> 3
 UNION ALL SELECT seed, 'unknown-' || example_id, example_id, doc, confidence, pick FROM again WHERE (example_id * 7 + seed) % 101 = 9),
a AS (SELECT *, count(*) AS n FROM again GROUP BY ALL), b AS (SELECT *, count(*) AS n FROM saved GROUP BY ALL),
d AS (SELECT coalesce(a.seed, b.seed) AS seed, coalesce(a.candidate_id, b.candidate_id) AS candidate_id, a.n AS n1, b.n AS n2 FROM a FULL JOIN b USING (seed, candidate_id, example_id, doc, confidence, pick) WHERE a.n IS DISTINCT FROM b.n),
s AS (SELECT seed, candidate_id, coalesce(sum(n1), 0)::bigint AS n_before, coalesce(sum(n2), 0)::bigint AS n_after FROM d GROUP BY ALL)
SELECT seed, candidate_id, CASE WHEN n_after = 0 THEN 'missing' WHEN n_before = 0 THEN 'added' ELSE 'changed' END AS change, n_before, n_after FROM s""",
    "foreign_runs": f"""WITH r AS (SELECT o_orderkey AS order_id, 'run-' || (o_orderkey % 9) AS own, concat('{{"run_id":"run-', o_orderkey % 9, '","lineage":', {_DEEP}, ',"others":',
 CASE WHEN o_orderkey % 29 = 5 THEN '["run-4",{{"run_id":["run-x",null]}}]' ELSE '[]' END, '}}')::json AS body FROM orders),
t AS (SELECT order_id, own, fullkey, regexp_extract(fullkey, '([A-Za-z_]+)(\\[[0-9]+\\])*$', 1) AS name, CASE WHEN j.type <> 'NULL' THEN j.atom->>'$' END AS value, j.type AS type FROM r, json_tree(r.body) j)
SELECT order_id, fullkey AS path, value FROM t WHERE name = 'run_id' AND type NOT IN ('OBJECT', 'ARRAY') AND value IS DISTINCT FROM own""",
    "pilot_gate": f"""WITH {verdicts.TRIES}, {journal.ATTEMPTS},
calls AS (SELECT event_id, attempt, event_type, json_keys(props) AS fields, (epoch_us(ts) - lag(epoch_us(ts) + round(value * 1e6)::bigint) OVER (PARTITION BY user_id, day, request ORDER BY attempt)) / 1e6 AS waited FROM attempts),
pairs AS (
 SELECT 'simple' AS mode, candidate_id AS id, response_status AS status, action AS one, action AS two, coalesce(emits, false) AS safe, coalesce(emits, false) AS emitted FROM plain_final
 UNION ALL SELECT 'corrective', candidate_id, response_status, action, CASE WHEN candidate_id % 17 = 4 THEN 'KEPT' ELSE action END, coalesce(emits, false), coalesce(emits, false) OR candidate_id % 19 = 6 FROM judged_final),
pilot AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT id FROM pairs WHERE mode = 'corrective')),
told AS (
 SELECT 'development-only-inputs' AS name, count(*) FILTER (WHERE c_nationkey = 24) AS n, min(id::varchar) FILTER (WHERE c_nationkey = 24) AS k FROM pilot
 UNION ALL SELECT 'full-development-index', (count(DISTINCT l_linenumber) <> 8)::int, NULL FROM lineitem
 UNION ALL SELECT 'predeclared-pilot-subset', count(*) FILTER (WHERE NOT coalesce(epoch_us(ts) > 0, false)), min(event_id::varchar) FILTER (WHERE NOT coalesce(epoch_us(ts) > 0, false)) FROM events
 UNION ALL SELECT 'live-capture-provenance', count(*) FILTER (WHERE event_id % 997 = 5), min(event_id::varchar) FILTER (WHERE event_id % 997 = 5) FROM events
 UNION ALL SELECT 'retry-error-policy', count(*) FILTER (WHERE (attempt = 2 AND waited < 1.95) OR (attempt = 3 AND waited < 3.95)), min(event_id::varchar) FILTER (WHERE (attempt = 2 AND waited < 1.95) OR (attempt = 3 AND waited < 3.95)) FROM calls
 UNION ALL SELECT 'gold-pairing', count(*) FILTER (WHERE c_mktsegment = 'MACHINERY'), min(id::varchar) FILTER (WHERE c_mktsegment = 'MACHINERY') FROM pilot
 UNION ALL SELECT 'development-threshold', (count(*) <> 5)::int, NULL FROM region
 UNION ALL SELECT 'prompt-evidence-separation', count(*) FILTER (WHERE len(list_filter(fields, lambda x: x <> 'k')) > 0), min(event_id::varchar) FILTER (WHERE len(list_filter(fields, lambda x: x <> 'k')) > 0) FROM calls
 UNION ALL SELECT mode || '-independent-calls', (count(*) FILTER (WHERE one IS DISTINCT FROM two) = 0)::int, NULL FROM pairs GROUP BY mode
 UNION ALL SELECT 'response-schema', count(*) FILTER (WHERE status <> 'valid_response'), min(id::varchar) FILTER (WHERE status <> 'valid_response') FROM pairs
 UNION ALL SELECT 'no-cache-reuse', count(*) FILTER (WHERE event_type = 'click'), min(event_id::varchar) FILTER (WHERE event_type = 'click') FROM calls
 UNION ALL SELECT 'correction-emission-safety', count(*) FILTER (WHERE safe <> emitted), min(id::varchar) FILTER (WHERE safe <> emitted) FROM pairs WHERE mode = 'corrective'
 UNION ALL SELECT mode || '-two-call-determinism', count(*) FILTER (WHERE one IS DISTINCT FROM two), min(id::varchar) FILTER (WHERE one IS DISTINCT FROM two) FROM pairs GROUP BY mode
 UNION ALL SELECT 'paired-condition-universe', (count(*) <> 2 * (SELECT count(*) FROM pilot) OR count(DISTINCT (mode, id)) <> count(*) OR count(DISTINCT mode) <> 2)::int, NULL FROM pairs)
SELECT name AS "check", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, n::bigint AS n_wrong, k AS first_wrong, bool_and(n = 0) OVER () AS all_passed FROM told""",
}
