"""The stream of fates equals the batch and a plain walk, however its rows are cut into batches."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd

from spanloom.streaming import fates

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def walk(rows):
    """Fates by a loop over each candidate's events."""
    known = max(r[1] for r in rows) - timedelta(microseconds=fates.LATENESS)
    expiry, found = timedelta(microseconds=fates.EXPIRY), []
    for user in {r[2] for r in rows}:
        attempts = []

        def close(fate, at, user=user):
            early = sum(b[1] < a[1] + timedelta(microseconds=w) for a, b, w in zip(attempts, attempts[1:], fates.BACKOFF))
            if at <= known:
                found.append((user, attempts[0][0], attempts[-1][0], len(attempts), early, fate, at))
            attempts.clear()

        for row in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if attempts and row[1] > attempts[-1][1] + expiry:
                close("expired", attempts[-1][1] + expiry)
            attempts.append(row)
            if row[3] == "purchase":
                close("valid", row[1])
            elif len(attempts) == 3:
                close("exhausted", row[1])
        if attempts:
            close("expired", attempts[-1][1] + expiry)
    return sorted(found)


def test_stream_in_batches_equals_a_walk(spark, tmp_path):
    draw = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i * 53 + draw.randrange(40), microseconds=draw.randrange(10**6)), draw.choice([0] * 8 + [1] * 8 + [2, 2, 3]), draw.choice(["purchase", "error", "view"])) for i in range(160)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "error") for i in range(0, 160, 20)]  # ties
    expect = walk(rows)
    assert {e[5] for e in expect} == {"valid", "exhausted", "expired"} and any(e[4] for e in expect)

    def tuples(frame):
        return sorted((r.user_id, r.first_event, r.last_event, r.attempts, r.early, r.fate, datetime(1970, 1, 1) + timedelta(microseconds=r.decided)) for r in frame.collect())

    df = spark.createDataFrame(rows, SCHEMA)
    assert tuples(fates.fates_in_batch(df)) == expect
    ordered = sorted(rows, key=lambda r: r[1])
    for nth in range(3):  # one file a batch; within a batch the rows are shuffled, and some come a batch late
        part = ordered[nth * 56 : nth * 56 + 56]
        draw.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "journal"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "journal"))
    before = spark.conf.get(fates.PROVIDER, None)
    assert tuples(fates.kept_in_rocksdb(fates.fates(source.withWatermark("ts", "6 hours")))) == expect
    assert spark.conf.get(fates.PROVIDER, None) == before


class Handle:
    """State and timers in memory; counts how often they are set."""

    def __init__(self):
        self.timers, self.writes, self.value = [], 0, None
        self.getListState = self.getValueState = lambda *_: Handle()

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def appendList(self, rows):
        self.value, self.writes = [*(self.value or []), *rows], self.writes + 1

    def appendValue(self, row):
        self.appendList([row])

    def put(self, value):
        self.value, self.writes = value, self.writes + 1

    def update(self, value):
        self.put(value)

    def clear(self):
        self.value = None


def test_events_of_a_batch_cost_one_access_and_one_timer():
    handle, n = Handle(), 50
    state = fates.Fates()
    state.init(handle)
    times = [fates.HOUR * (i + 1) for i in range(n)][::-1]
    list(state.handleInputRows((7,), iter([pd.DataFrame({"micros": times, "event_id": range(n), "valid": [True] * n})]), None))
    assert state.waiting.writes == 1 and handle.timers == [fates.HOUR // 1000]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 20 * fates.HOUR // 1000)
    (told,) = state.handleExpiredTimer((7,), now, None)
    assert len(told) == 20 and handle.timers[1:] == [21 * fates.HOUR // 1000]  # those that wait have the next timer
    assert list(state.handleExpiredTimer((7,), now, None)) == []
