"""Attempt ledgers, event logs, responses, inventories, storage and lineage. The events table is the journal: user_id stands for the candidate, event_type for the status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import lineage
from spanloom.plans.scoring import read

MAX_ATTEMPTS = 3
BACKOFF = (2.0, 4.0)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events cut into requests of up to three attempts per candidate and day, in order of time."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    nth = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")) - 1
    return events.withColumn("nth", nth).select(
        "event_id", "user_id", "day", "ts", "event_type", "value", "props",
        F.floor(F.col("nth") / MAX_ATTEMPTS).alias("request"), (F.col("nth") % MAX_ATTEMPTS + 1).cast("int").alias("attempt"))


ATTEMPTS = f"""
attempts AS (
  SELECT *, nth // {MAX_ATTEMPTS} AS request, (nth % {MAX_ATTEMPTS} + 1)::int AS attempt
  FROM (SELECT *, ts::date AS day, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id) - 1 AS nth FROM events))
"""


def attempt_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per candidate: attempts, retries, failures, token sums (null if nothing was measured) and durations."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    return attempts(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.countDistinct("day", "request").alias("n_requests"), F.count_if(F.col("attempt") > 1).alias("n_retries"),
        F.count_if(F.col("event_type") == "error").alias("n_failures"), F.sum(tokens).alias("tokens"), F.count(tokens).alias("n_measured"), F.round(F.sum("value"), 4).alias("seconds"))


def response_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by status of what is not served from cache (a click counts as cached); sums stay null where nothing was measured."""
    live = read(spark, sf_dir, "events").where("event_type <> 'click'")
    measured = F.when(F.col("event_type") != "error", F.col("value"))
    return live.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(measured).alias("n_measured"), F.round(F.sum(measured), 4).alias("seconds"), F.max("value").alias("longest"))


def retry_backoff_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries that begin earlier after the one before has ended than the backoff asks for (0.05 s of grace)."""
    order = Window.partitionBy("user_id", "day", "request").orderBy("attempt")
    started, ended = F.unix_micros(F.col("ts").cast("timestamp")), F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e6).cast("long")
    gap = started - F.lag(ended).over(order)
    need = F.when(F.col("attempt") == 2, BACKOFF[0]).otherwise(BACKOFF[1]) * 1e6
    checked = attempts(spark, sf_dir).withColumn("gap", gap).where("gap IS NOT NULL").withColumn("violates", F.col("gap") + 50_000 < need)
    return checked.groupBy("attempt").agg(F.count(F.lit(1)).alias("n"), F.count_if("violates").alias("n_violations"), F.min("gap").alias("least_micros"))


def event_sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per candidate: whether its log is chronological by id, and its first and last event."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    seen = read(spark, sf_dir, "events").withColumn("back", (F.col("ts") < F.lag("ts").over(order)).cast("int"))
    ends = F.struct("event_id", "event_type")
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("n_out_of_order"), F.min(ends)["event_type"].alias("first_event"), F.max(ends)["event_type"].alias("last_event"))


def attempt_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts run 1..n, n is at most three, and nothing follows a valid response: how many requests break each rule."""
    held = attempts(spark, sf_dir).groupBy("user_id", "day", "request").agg(F.array_sort(F.collect_list(F.struct("attempt", (F.col("event_type") == "purchase").alias("valid")))).alias("a"))
    contiguous = F.forall(F.transform("a", lambda x, i: x["attempt"] == i + 1), lambda ok: ok)
    after = F.exists(F.slice("a", F.lit(1), F.size("a") - 1), lambda x: x["valid"])
    return held.agg(F.count(F.lit(1)).alias("n"), F.count_if(~contiguous).alias("n_gaps"), F.count_if(F.size("a") > MAX_ATTEMPTS).alias("n_long"), F.count_if(after).alias("n_after_valid"))


def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's verdict: its first valid attempt (a purchase), else its last one."""
    valid = F.min(F.when(F.col("event_type") == "purchase", F.struct("attempt", "event_id", "event_type")))
    last = F.max(F.struct("attempt", "event_id", "event_type"))
    chosen = attempts(spark, sf_dir).groupBy("user_id", "day", "request").agg(F.coalesce(valid, last).alias("x"))
    return chosen.select("user_id", F.col("day").cast("string").alias("day"), "request", "x.attempt", "x.event_id", "x.event_type")


def invocation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts (views) and finishes (purchases) paired by ordinal per candidate: hours, and sides that stand alone."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events")
    starts = events.where("event_type = 'view'").select("user_id", F.row_number().over(order).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"))
    ends = events.where("event_type = 'purchase'").select("user_id", F.row_number().over(order).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("e"))
    both = starts.join(ends, ["user_id", "k"], "full")
    return both.groupBy("user_id").agg(
        F.count_if(F.col("s").isNotNull() & F.col("e").isNotNull()).alias("completed"), F.count_if(F.col("e").isNull()).alias("missing_finish"),
        F.count_if(F.col("s").isNull()).alias("finish_without_start"), F.sum(F.col("e") - F.col("s")).alias("micros"))


def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in JSON: exact keys, range, and what is malformed (every seventh is cut short)."""
    raw = F.when(F.col("event_id") % 7 == 3, F.expr("left(props, length(props) - 2)")).when(F.col("event_id") % 11 == 4, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "x": 1}'))).otherwise(F.col("props"))
    parsed = read(spark, sf_dir, "events").withColumn("raw", raw).withColumn("keys", F.json_object_keys("raw")).withColumn("k", F.get_json_object("raw", "$.k").cast("int"))
    status = (
        F.when(F.col("keys").isNull() | ~F.col("raw").endswith("}"), "malformed")
        .when(F.size("keys") != 1, "schema_invalid")
        .when((F.col("k") < 0) | (F.col("k") > 99), "out_of_range")
        .when(F.col("k") >= 50, "KEEP")
        .otherwise("DISCARD")
    )
    return parsed.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def inventory(spark: SparkSession, sf_dir: str, shifted: bool) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    if shifted:
        orders = orders.where("o_orderkey % 29 <> 3").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 31 == 7, "X").otherwise(F.col("o_orderstatus")))
    else:
        orders = orders.where("o_orderkey % 37 <> 5")
    return orders.select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256).alias("sha256"))


INVENTORY = """
old AS (SELECT 'o/' || o_orderkey AS path, sha256(concat_ws('|', o_custkey, o_orderstatus)) AS h FROM orders WHERE o_orderkey % 37 <> 5),
new AS (SELECT 'o/' || o_orderkey AS path, sha256(concat_ws('|', o_custkey, CASE WHEN o_orderkey % 31 = 7 THEN 'X' ELSE o_orderstatus END)) AS h FROM orders WHERE o_orderkey % 29 <> 3)
"""


def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that were added, removed or changed between two inventories."""
    old, new = inventory(spark, sf_dir, False).withColumnRenamed("sha256", "a"), inventory(spark, sf_dir, True).withColumnRenamed("sha256", "b")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return old.join(new, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of an inventory: of the sorted rows of each part (the first four digits of the path's hash), of the parts of each
    folder (the first two), and of all folders (the row without a folder). No level gathers more than its children."""
    row = F.concat("path", F.lit("|"), "sha256", F.lit("\n"))
    level = inventory(spark, sf_dir, False).select(F.substring(F.sha2("path", 256), 1, 4).alias("part"), row.alias("row"), F.lit(1).cast("long").alias("n"))
    rows = None
    for digits in (4, 2, 0):
        text = F.array_join(F.array_sort(F.collect_list("row")), "")
        level = level.groupBy(F.substring("part", 1, digits).alias("part")).agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n"))
        level = level.select("part", "n", "digest", F.concat("part", F.lit("|"), "digest", F.lit("\n")).alias("row"))
        if digits < 4:
            told = level.select("part", "n", "digest")
            rows = told if rows is None else rows.unionByName(told)
    return rows


def storage_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of files counted once per (device, inode), against a budget."""
    files = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("device"), F.col("l_orderkey").alias("inode"), F.col("l_quantity").cast("long").alias("blocks"))
    once = files.groupBy("device", "inode").agg(F.max("blocks").alias("blocks"))
    used = once.groupBy("device").agg(F.count(F.lit(1)).alias("n_files"), (F.sum("blocks") * 512).alias("bytes"))
    return used.withColumn("left_of_budget", F.greatest(F.lit(0), F.lit(10**8) - F.col("bytes")))


def repeat_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repeats of a verdict by id, field by field and null-safe."""
    first = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("action"), F.col("o_orderpriority").alias("reason"))
    second = first.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 41 == 9, None).otherwise(F.col("action")).alias("action2"), F.when(F.col("o_orderkey") % 43 == 2, "other").otherwise(F.col("reason")).alias("reason2"))
    both = first.join(second, "o_orderkey", "full")
    action, reason = ~F.col("action").eqNullSafe(F.col("action2")), ~F.col("reason").eqNullSafe(F.col("reason2"))
    return both.where(action | reason).select("o_orderkey", action.alias("action_differs"), reason.alias("reason_differs"))


def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned against attempted: orders whose line items are not the four that each order plans for."""
    planned = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("planned"))
    done = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg((F.count(F.lit(1)) * 4).alias("done"))
    return planned.join(done, "k", "full").select("k", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("done", F.lit(0)).alias("done")).where("planned <> done")


def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without response, responses without request, and pairs."""
    asked = read(spark, sf_dir, "orders").where("o_orderkey % 13 <> 1").select("o_orderkey").withColumn("a", F.lit(1))
    said = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("b", F.lit(1))
    both = asked.join(said, "o_orderkey", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("covered"))


def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending a log to itself, partly overlapping: events that are there (same type, candidate, minute) are not added again."""
    events = read(spark, sf_dir, "events").select("event_type", "user_id", F.date_trunc("minute", "ts").alias("minute"), "event_id")
    key = ["event_type", "user_id", "minute"]
    saved = events.where("event_id % 3 <> 0").groupBy(*key).agg(F.min("event_id").alias("event_id"))
    added = events.groupBy(*key).agg(F.min("event_id").alias("event_id")).join(saved.select(*key), key, "left_anti")
    return saved.withColumn("state", F.lit("saved")).unionByName(added.withColumn("state", F.lit("added"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def unfinished_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned turns whose last saved answer is empty or an error are asked again."""
    plan = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    saved = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.when(F.col("conv_id") % 5 == 2, "ERROR: timeout").otherwise(F.col("text")).alias("answer"))
    done = saved.where("answer <> '' AND NOT startswith(answer, 'ERROR:')").select("conv_id", "turn")
    return plan.join(done, ["conv_id", "turn"], "left_anti")


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts within thirty minutes of each other are one session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").withColumn("fresh", F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order) < 1_800_000_000, 0).otherwise(1))
    return events.groupBy("user_id").agg(F.sum("fresh").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order comes from its customer's order before it."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.lag("o_orderkey").over(order).alias("parent")).where("parent IS NOT NULL")


def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of every order within its customer's chain, at any depth: counted on the way up, not listed."""
    found = lineage.totals(lineage_edges(spark, sf_dir).withColumn("broken", F.lit(False)))
    return found.select("child", "n_ancestors", F.col("n_ancestors").cast("int").alias("depth"), "oldest")


def two_parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Artifacts (id, sha256), and what they recorded of their parents: the customer's order before, and the last before of the same state
    and priority. Every 23rd artifact has a stale hash of its parents; the parents of every 41st are of another run, and absent."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderpriority", F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("sha256"))
    before = Window.partitionBy("o_custkey").orderBy("id")
    like = Window.partitionBy("o_custkey", "o_orderstatus", "o_orderpriority").orderBy("id")
    both = orders.select("id", F.lag("id").over(before).alias("one"), F.lag("id").over(like).alias("two"))
    both = both.select("id", F.explode(F.array_distinct(F.array("one", "two"))).alias("parent")).where("parent IS NOT NULL")
    told = both.join(orders.select(F.col("id").alias("parent"), F.col("sha256").alias("now")), "parent")
    stale = F.when(F.col("id") % 23 == 3, F.sha2("now", 256)).otherwise(F.col("now"))
    parent = F.when(F.col("id") % 41 == 7, -F.col("parent") - 1).otherwise(F.col("parent"))
    return orders.select("id", "sha256"), told.select(F.col("id").alias("child"), parent.alias("parent"), stale.alias("parent_sha256"))


def lineage_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts with two parents each: generation, own broken links, whether all above is sound, and the oldest they descend from."""
    artifacts, parents = two_parents(spark, sf_dir)
    return lineage.judged(lineage.recorded(artifacts, parents), artifacts)


def lineage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts record their parent's hash; every 23rd record is stale, and spoils whatever descends from it."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus"), 256).alias("sha256"))
    links = lineage_edges(spark, sf_dir).select(F.col("child").alias("id"), "parent")
    held = orders.select(F.col("id").alias("parent"), F.col("sha256").alias("parent_sha256"))
    recorded = links.join(held, "parent").withColumn("parent_sha256", F.when(F.col("id") % 23 == 3, F.sha2("parent_sha256", 256)).otherwise(F.col("parent_sha256")))
    return lineage.validated(orders.join(recorded, "id", "left"))


def lineage_closure_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every order within its customer's chain, without a limit of depth: those of artifact n are all before it."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    chain = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("child"), (F.row_number().over(order) - 1).cast("long").alias("n_ancestors"), F.first("o_orderkey").over(order).alias("oldest"))
    return chain.where("n_ancestors > 0").select("child", "n_ancestors", F.col("n_ancestors").cast("int").alias("depth"), "oldest")


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks of a pilot and whether all pass."""
    orders = read(spark, sf_dir, "orders")
    found = orders.agg(
        (F.count(F.lit(1)) == F.countDistinct("o_orderkey")).alias("unique_ids"), (F.count_if(F.col("o_custkey").isNull()) == 0).alias("complete_keys"),
        (F.min("o_totalprice") >= 0).alias("nonnegative"), (F.countDistinct("o_orderstatus") == 3).alias("known_states"), (F.max("o_orderdate") < F.lit("1990-01-01")).alias("before_1990"))
    names = ("unique_ids", "complete_keys", "nonnegative", "known_states", "before_1990")
    rows = found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])).alias("x")).select("x.*")
    everything = Window.partitionBy(F.lit(1))
    return rows.withColumn("all_passed", F.min("passed").over(everything))


QUERIES = {
    f.__name__: f
    for f in (
        attempt_telemetry, response_statistics, retry_backoff_check, event_sequence_check, attempt_contiguity, first_valid_attempt, invocation_cost, response_parse,
        inventory_diff, tree_digest, storage_account, repeat_mismatch, multiset_equality, coverage_check, idempotent_append, unfinished_occurrences, session_report,
        lineage_closure, lineage_closure_whole, lineage_validation, lineage_judgement, gate_checks,
    )
}

ORACLES = {
    "attempt_telemetry": f"""WITH {ATTEMPTS} SELECT user_id, count(*) AS n_attempts, count(DISTINCT (day, request)) AS n_requests, count(*) FILTER (WHERE attempt > 1) AS n_retries,
 count(*) FILTER (WHERE event_type = 'error') AS n_failures, sum((props->>'$.k')::bigint)::bigint AS tokens, count(props->>'$.k') AS n_measured, round(sum(value), 4) AS seconds FROM attempts GROUP BY user_id""",
    "response_statistics": """SELECT event_type, count(*) AS n, count(value) FILTER (WHERE event_type <> 'error') AS n_measured, round(sum(value) FILTER (WHERE event_type <> 'error'), 4) AS seconds, max(value) AS longest
FROM events WHERE event_type <> 'click' GROUP BY event_type""",
    "retry_backoff_check": f"""WITH {ATTEMPTS}, g AS (SELECT attempt, epoch_us(ts) - lag(epoch_us(ts) + round(value * 1e6)::bigint) OVER (PARTITION BY user_id, day, request ORDER BY attempt) AS gap FROM attempts)
SELECT attempt, count(*) AS n, count(*) FILTER (WHERE gap + 50000 < CASE WHEN attempt = 2 THEN 2e6 ELSE 4e6 END) AS n_violations, min(gap) AS least_micros FROM g WHERE gap IS NOT NULL GROUP BY attempt""",
    "event_sequence_check": """WITH s AS (SELECT *, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE back) AS n_out_of_order, arg_min(event_type, event_id) AS first_event, arg_max(event_type, event_id) AS last_event FROM s GROUP BY user_id""",
    "attempt_contiguity": f"""WITH {ATTEMPTS}, r AS (SELECT user_id, day, request, count(*) AS n, max(attempt) AS m, bool_or(event_type = 'purchase' AND attempt < top) AS after
 FROM (SELECT *, max(attempt) OVER (PARTITION BY user_id, day, request) AS top FROM attempts) GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (WHERE n <> m) AS n_gaps, count(*) FILTER (WHERE n > {MAX_ATTEMPTS}) AS n_long, count(*) FILTER (WHERE after) AS n_after_valid FROM r""",
    "first_valid_attempt": f"""WITH {ATTEMPTS} SELECT user_id, day::varchar AS day, request, attempt, event_id, event_type FROM attempts
QUALIFY row_number() OVER (PARTITION BY user_id, day, request ORDER BY event_type = 'purchase' DESC, CASE WHEN event_type = 'purchase' THEN attempt ELSE -attempt END) = 1""",
    "invocation_cost": """WITH s AS (SELECT user_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view'),
e AS (SELECT user_id, epoch_us(ts) AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase')
SELECT user_id, count(*) FILTER (WHERE s IS NOT NULL AND e IS NOT NULL) AS completed, count(*) FILTER (WHERE e IS NULL) AS missing_finish, count(*) FILTER (WHERE s IS NULL) AS finish_without_start,
 sum(e - s)::bigint AS micros FROM s FULL JOIN e USING (user_id, k) GROUP BY user_id""",
    "response_parse": """WITH r AS (SELECT CASE WHEN event_id % 7 = 3 THEN left(props, length(props) - 2) WHEN event_id % 11 = 4 THEN left(props, length(props) - 1) || ', "x": 1}' ELSE props END AS raw FROM events),
p AS (SELECT raw, json_valid(raw) AS ok FROM r)
SELECT CASE WHEN NOT ok THEN 'malformed' WHEN len(json_keys(raw)) <> 1 THEN 'schema_invalid' WHEN (raw->>'$.k')::int NOT BETWEEN 0 AND 99 THEN 'out_of_range' WHEN (raw->>'$.k')::int >= 50 THEN 'KEEP' ELSE 'DISCARD' END AS status,
 count(*) AS n FROM (SELECT CASE WHEN ok THEN raw ELSE '{}' END AS raw, ok FROM p) GROUP BY 1""",
    "inventory_diff": f"""WITH {INVENTORY} SELECT path, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old FULL JOIN new USING (path) WHERE old.h IS DISTINCT FROM new.h""",
    "tree_digest": f"""WITH {INVENTORY}, leaf AS (SELECT substr(sha256(path), 1, 4) AS part, count(*) AS n, sha256(string_agg(path || '|' || h || chr(10), '' ORDER BY path || '|' || h)) AS digest FROM old GROUP BY 1),
folder AS (SELECT substr(part, 1, 2) AS part, sum(n)::bigint AS n, sha256(string_agg(part || '|' || digest || chr(10), '' ORDER BY part)) AS digest FROM leaf GROUP BY 1)
SELECT * FROM folder UNION ALL SELECT '' AS part, sum(n)::bigint AS n, sha256(string_agg(part || '|' || digest || chr(10), '' ORDER BY part)) AS digest FROM folder""",
    "storage_account": """WITH o AS (SELECT l_suppkey % 3 AS device, l_orderkey AS inode, max(trunc(l_quantity)::bigint) AS blocks FROM lineitem GROUP BY ALL)
SELECT device, count(*) AS n_files, (sum(blocks) * 512)::bigint AS bytes, greatest(0, 100000000 - sum(blocks) * 512)::bigint AS left_of_budget FROM o GROUP BY device""",
    "repeat_mismatch": """WITH p AS (SELECT o_orderkey, o_orderkey % 41 = 9 AND o_orderstatus IS NOT NULL AS action_differs, o_orderkey % 43 = 2 AND o_orderpriority IS DISTINCT FROM 'other' AS reason_differs FROM orders)
SELECT * FROM p WHERE action_differs OR reason_differs""",
    "multiset_equality": """WITH p AS (SELECT l_orderkey AS k, count(*) AS planned FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS k, count(*) * 4 AS done FROM orders GROUP BY 1)
SELECT k, coalesce(planned, 0) AS planned, coalesce(done, 0) AS done FROM p FULL JOIN d USING (k) WHERE coalesce(planned, 0) <> coalesce(done, 0)""",
    "coverage_check": """WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 1), b AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS missing, count(*) FILTER (WHERE o_orderkey IS NULL) AS extra, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL) AS covered FROM a FULL JOIN b ON o_orderkey = l_orderkey""",
    "idempotent_append": """WITH e AS (SELECT event_type, user_id, date_trunc('minute', ts) AS minute, event_id FROM events),
s AS (SELECT event_type, user_id, minute, min(event_id) AS event_id FROM e WHERE event_id % 3 <> 0 GROUP BY ALL), a AS (SELECT event_type, user_id, minute, min(event_id) AS event_id FROM e GROUP BY ALL)
SELECT 'saved' AS state, count(*) AS n, sum(event_id)::bigint AS ids FROM s UNION ALL
SELECT 'added', count(*), sum(event_id)::bigint FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.event_type = a.event_type AND s.user_id = a.user_id AND s.minute = a.minute)""",
    "unfinished_occurrences": """SELECT conv_id, turn FROM conversations p WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = p.conv_id AND a.turn = p.turn + 1
 AND CASE WHEN a.conv_id % 5 = 2 THEN 'ERROR: timeout' ELSE a.text END <> '' AND NOT starts_with(CASE WHEN a.conv_id % 5 = 2 THEN 'ERROR: timeout' ELSE a.text END, 'ERROR:'))""",
    "session_report": """WITH f AS (SELECT user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000, false) AS goes_on FROM events)
SELECT user_id, count(*) FILTER (WHERE NOT goes_on) AS n_sessions, count(*) AS n_events FROM f GROUP BY user_id""",
    "lineage_closure": """WITH RECURSIVE edges AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
walk AS (SELECT child, parent, 1 AS depth FROM edges WHERE parent IS NOT NULL UNION ALL SELECT w.child, e.parent, depth + 1 FROM walk w JOIN edges e ON w.parent = e.child WHERE e.parent IS NOT NULL)
SELECT child, count(*) AS n_ancestors, max(depth) AS depth, min(parent) AS oldest FROM walk GROUP BY child""",
    "lineage_closure_whole": """WITH c AS (SELECT o_orderkey AS child, row_number() OVER w - 1 AS n, first_value(o_orderkey) OVER w AS oldest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT child, n AS n_ancestors, n::int AS depth, oldest FROM c WHERE n > 0""",
    "lineage_validation": """WITH c AS (SELECT o_orderkey AS id, row_number() OVER w - 1 AS n_ancestors, count(*) FILTER (WHERE o_orderkey % 23 = 3 AND NOT head) OVER w AS n_broken
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS head FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT id, n_ancestors, n_broken, n_broken = 0 AS valid FROM c""",
    "lineage_judgement": """WITH RECURSIVE a AS (
 SELECT o_orderkey AS id, unnest(list_distinct([lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey)])) AS parent FROM orders),
links AS (SELECT id AS child, parent, id % 41 = 7 AS absent, id % 23 = 3 OR id % 41 = 7 AS broken FROM a WHERE parent IS NOT NULL),
walk AS (SELECT o_orderkey AS id, o_orderkey AS up, 0 AS depth FROM orders UNION SELECT w.id, l.parent, depth + 1 FROM walk w JOIN links l ON l.child = w.up AND NOT l.absent),
own AS (SELECT child, count(*) FILTER (WHERE broken) AS n_broken FROM links GROUP BY child)
SELECT w.id, max(depth)::int AS generation, coalesce(any_value(n.n_broken), 0)::bigint AS n_broken, count(*) FILTER (WHERE o.n_broken > 0) = 0 AS valid, min(up) AS oldest
FROM walk w LEFT JOIN own o ON o.child = w.up LEFT JOIN own n ON n.child = w.id GROUP BY w.id""",
    "gate_checks": """WITH f AS (SELECT count(*) = count(DISTINCT o_orderkey) AS unique_ids, count(*) FILTER (WHERE o_custkey IS NULL) = 0 AS complete_keys, min(o_totalprice) >= 0 AS nonnegative,
 count(DISTINCT o_orderstatus) = 3 AS known_states, max(o_orderdate) < TIMESTAMP '1990-01-01' AS before_1990 FROM orders),
r AS (SELECT unnest(['unique_ids', 'complete_keys', 'nonnegative', 'known_states', 'before_1990']) AS "check", unnest([unique_ids, complete_keys, nonnegative, known_states, before_1990]) AS passed FROM f)
SELECT "check", passed, bool_and(passed) OVER () AS all_passed FROM r""",
}
