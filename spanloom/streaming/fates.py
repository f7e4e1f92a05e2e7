"""The fate of each request of an attempt journal, kept in state per candidate, with event-time timers; a batch twin gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from spanloom.plans.journal import MAX_ATTEMPTS
from spanloom.plans.scoring import read
from spanloom.streaming.events import _stream, drained

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000
#: Microseconds: a request without an attempt for so long has expired; the second and third attempt wait so long (a journal of days stands for one of seconds).
EXPIRY, BACKOFF = 24 * HOUR, (2 * HOUR, 4 * HOUR)
#: How late an event may come.
LATENESS = 6 * HOUR
FATE = "user_id long, first_event long, last_event long, attempts int, early int, fate string, decided long"


def due_at(micros: int) -> int:
    """The first millisecond by which a time has come."""
    return -(-micros // 1000)


class Fates(StatefulProcessor):
    """State of a candidate: events that the watermark has not passed, and the open request.

    Events wait in a list until the watermark has passed them, so the order in which batches bring them does not matter; then
    they are taken in the order of (time, event). The events of a batch cost one access to the state and one timer, at the first
    of them; when it is due, those that still wait get the next. A request is emitted once: when an attempt is valid, when the last allowed
    attempt was not, or, by a timer, when its time to expire has passed.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, valid boolean")
        self.open = handle.getValueState("open", "first_event long, last_event long, attempts int, early int, last_ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = [e for batch in rows for e in zip(batch["micros"].tolist(), batch["event_id"].tolist(), batch["valid"].tolist(), strict=True)]
        if events:
            self.waiting.appendList(events)
            self.handle.registerTimer(due_at(min(events)[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer set here for a time that has passed would wait for a batch that may not come, so all that is due by the
        # watermark is done at the first timer of a batch
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        due = [w for w in waiting if w[0] <= now]
        if due:
            if len(due) < len(waiting):
                self.waiting.put(waiting[len(due) :])
                self.handle.registerTimer(due_at(waiting[len(due)][0]))
            else:
                self.waiting.clear()
        request = tuple(self.open.get()) if self.open.exists() else None
        emitted = []

        def close(fate: str, decided: int) -> None:
            emitted.append((key[0], *request[:4], fate, decided))

        for ts, event_id, valid in due:
            if request and ts > request[4] + EXPIRY:
                close("expired", request[4] + EXPIRY)
                request = None
            if request is None:
                request = (event_id, event_id, 1, 0, ts)
            else:
                early = ts < request[4] + BACKOFF[request[2] - 1]
                request = (request[0], event_id, request[2] + 1, request[3] + int(early), ts)
            if valid or request[2] == MAX_ATTEMPTS:
                close("valid" if valid else "exhausted", ts)
                request = None
        if request and now >= request[4] + EXPIRY:
            close("expired", request[4] + EXPIRY)
            request = None
        if request is None:
            self.open.clear()
        else:
            self.open.update(request)
            if due:
                self.handle.registerTimer(due_at(request[4] + EXPIRY))
        if emitted:
            yield pd.DataFrame(emitted, columns=[f.split()[0] for f in FATE.split(", ")])

    def close(self) -> None:
        pass


def fates(journal: DataFrame) -> DataFrame:
    """Streaming: FATE rows of a journal (event_id, ts, user_id, event_type) with a watermark on ts."""
    rows = journal.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("micros"), (F.col("event_type") == "purchase").alias("valid"))
    return rows.groupBy("user_id").transformWithStateInPandas(Fates(), FATE, "append", "EventTime")


def kept_in_rocksdb(df: DataFrame) -> DataFrame:
    """Drains a stream whose state needs the RocksDB store; the session's own choice is put back."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return drained(df, "append")
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def fates_in_batch(journal: DataFrame) -> DataFrame:
    """The same rows from a whole journal by windows: those decided by the latest time less the lateness."""
    order = Window.partitionBy("user_id").orderBy("micros", "event_id")
    rows = journal.select("user_id", "event_id", F.unix_micros("ts").alias("micros"), (F.col("event_type") == "purchase").alias("valid"))
    before = F.lag("micros").over(order)
    fresh = F.coalesce((F.col("micros") > before + EXPIRY) | F.lag("valid").over(order), F.lit(True))
    runs = rows.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    placed = runs.withColumn("nth", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("micros", "event_id")) - 1)
    request = placed.withColumn("request", F.floor(F.col("nth") / MAX_ATTEMPTS)).withColumn("attempt", (F.col("nth") % MAX_ATTEMPTS + 1).cast("int"))
    inside = Window.partitionBy("user_id", "run", "request").orderBy("attempt")
    wait = F.when(F.col("attempt") == 2, BACKOFF[0]).otherwise(BACKOFF[1])
    early = F.coalesce((F.col("micros") < F.lag("micros").over(inside) + wait).cast("int"), F.lit(0))
    held = request.withColumn("early", early).groupBy("user_id", "run", "request").agg(
        F.min(F.struct("attempt", "event_id"))["event_id"].alias("first_event"), F.max(F.struct("attempt", "event_id"))["event_id"].alias("last_event"),
        F.max("attempt").alias("attempts"), F.sum("early").cast("int").alias("early"), F.max("valid").alias("valid"), F.max("micros").alias("last"))
    fate = F.when(F.col("valid"), "valid").when(F.col("attempts") == MAX_ATTEMPTS, "exhausted").otherwise("expired")
    decided = F.col("last") + F.when(fate == "expired", EXPIRY).otherwise(0)
    known = journal.agg((F.unix_millis(F.max("ts")) * 1000 - LATENESS).alias("known"))  # one row; watermarks are in milliseconds
    return held.select("user_id", "first_event", "last_event", "attempts", "early", fate.alias("fate"), decided.alias("decided")).join(F.broadcast(known), F.col("decided") <= F.col("known")).drop("known")


def request_fates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fates of the requests in the events, read as a stream."""
    return kept_in_rocksdb(fates(_stream(spark, sf_dir).withWatermark("ts", f"{LATENESS // HOUR} hours")))


def request_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return fates_in_batch(events.withColumn("ts", F.col("ts").cast("timestamp")))


QUERIES = {"request_fates_stream": request_fates_stream, "request_fates": request_fates}

SQL = f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS micros, event_type = 'purchase' AS valid FROM events),
f AS (SELECT *, coalesce(micros > lag(micros) OVER o + {EXPIRY} OR lag(valid) OVER o, true) AS fresh FROM e WINDOW o AS (PARTITION BY user_id ORDER BY micros, event_id)),
r AS (SELECT *, sum(fresh::int) OVER (PARTITION BY user_id ORDER BY micros, event_id) AS run FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY micros, event_id) - 1 AS nth FROM r),
a AS (SELECT *, nth // {MAX_ATTEMPTS} AS request, nth % {MAX_ATTEMPTS} + 1 AS attempt, lag(micros) OVER (PARTITION BY user_id, run, nth // {MAX_ATTEMPTS} ORDER BY nth) AS before FROM n),
h AS (SELECT user_id, arg_min(event_id, attempt) AS first_event, arg_max(event_id, attempt) AS last_event, max(attempt)::int AS attempts,
 (count(*) FILTER (WHERE micros < before + CASE attempt WHEN 2 THEN {BACKOFF[0]} ELSE {BACKOFF[1]} END))::int AS early, bool_or(valid) AS valid, max(micros) AS last FROM a GROUP BY user_id, run, request),
d AS (SELECT user_id, first_event, last_event, attempts, early, CASE WHEN valid THEN 'valid' WHEN attempts = {MAX_ATTEMPTS} THEN 'exhausted' ELSE 'expired' END AS fate, last FROM h),
t AS (SELECT * EXCLUDE (last), last + CASE fate WHEN 'expired' THEN {EXPIRY} ELSE 0 END AS decided FROM d)
SELECT * FROM t WHERE decided <= (SELECT epoch_ms(max(ts)) * 1000 - {LATENESS} FROM events)"""

ORACLES = {"request_fates_stream": SQL, "request_fates": SQL}
