"""Schedules as columns against a scan of minutes, as-of joins against a look at every row."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docmill.functions import schedules, times
from docmill.operators import asof

GOOD = ("* * * * *", "*/7 3-5,22 * * *", "0 0 31 * *", "59 23 28-31 2,12 *", "15 */8 */10 * 1-5", "@weekly", "@yearly", "30 6 13 * 5", "5/20 1/6 * 4-9/2 0,6", "0 12 29 2 *")
BAD = ("", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "a * * * *", "5-1 * * * *", "*/0 * * * *", "@never")


def slow_next(expression: str, at: dt.datetime, days: int = 366 * 9) -> dt.datetime | None:
    cron = times.parse_cron(expression)
    day, first = at.date(), at.hour * 60 + at.minute + 1
    for _ in range(days):
        if day.month in cron.month and day.day in cron.day and (day.weekday() + 1) % 7 in cron.weekday:
            for minute in range(first, 1440):
                if minute // 60 in cron.hour and minute % 60 in cron.minute:
                    return dt.datetime.combine(day, dt.time(minute // 60, minute % 60))
        day, first = day + dt.timedelta(days=1), 0
    return None


def test_next_runs_equal_a_scan_of_minutes(spark):
    rng = random.Random(6)
    rows = [(e, dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rng.randint(0, 3 * 365 * 86_400))) for e in GOOD for _ in range(12)]
    rows += [(e, dt.datetime(2024, 2, 29, 23, 59, 30)) for e in GOOD] + [(e, dt.datetime(2024, 12, 31, 23, 59)) for e in GOOD]
    got = schedules.with_next_run(spark.createDataFrame(rows, "cron string, ts timestamp_ntz"), "cron", "ts").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.next_run == slow_next(r.cron, r.ts), (r.cron, r.ts)


def test_what_is_no_schedule_never_runs(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(e, at) for e in (*BAD, "0 0 31 2 *", None)] + [("* * * * *", None)]
    out = schedules.with_next_run(spark.createDataFrame(rows, "cron string, ts timestamp_ntz"), "cron", "ts").collect()
    assert len(out) == len(rows) and all(r.next_run is None for r in out)
    assert schedules.due_runs(spark.createDataFrame(rows[:-1], "cron string, ts timestamp_ntz"), "cron", "2024-01-01", "2024-03-01").count() == 0


def test_due_runs(spark):
    start, end = dt.datetime(2024, 2, 27, 22, 59), dt.datetime(2024, 3, 1, 6, 30)
    df = spark.createDataFrame([(e,) for e in GOOD], "cron string")
    got = {(r.cron, r.due) for r in schedules.due_runs(df, "cron", str(start), str(end)).collect()}
    want = set()
    for e in GOOD:
        at = slow_next(e, start)
        while at and at <= end:
            want.add((e, at))
            at = slow_next(e, at)
    assert got == want


@pytest.mark.parametrize("cron,last,run", [
    ("*/15 1 2 3 4", "10:20:30", "10:35:30"), ("* */3 * * *", "10:20:30", "13:20:30"), ("* * * * *", "10:20:30", "10:21:30"), ("30 * * * *", "10:20:30", "10:30:00"), ("20 * * * *", "10:20:30", "11:20:00"),
    ("5 23 * * *", "10:20:30", "23:05:00"), ("* * 1 * *", "10:20:30", "24:00:00"), ("* 9 * * *", "10:20:30", "11:09:00"), ("x * * * *", "10:20:30", None), ("* * *", "10:20:30", None), ("*/0 * * * *", "10:20:30", None),
])
def test_simple_schedules(spark, cron, last, run):
    day = dt.datetime(2024, 5, 6)
    at = lambda s: day + dt.timedelta(**dict(zip(("hours", "minutes", "seconds"), map(int, s.split(":"))))) if s else None
    df = spark.createDataFrame([(cron, at(last))], "cron string, ts timestamp")
    assert df.select(schedules.simple_next_run("cron", "ts").alias("r")).first().r == at(run)


@pytest.mark.parametrize("seconds", [30, 86_400])
def test_as_of_equals_a_look_at_every_row(spark, seconds):
    """A key with most rows, ties in time, nulls in keys and times, repeated rows."""
    rng = random.Random(8)
    day = dt.datetime(2024, 1, 1)
    at = lambda: day + dt.timedelta(seconds=rng.randint(0, 600)) if rng.random() > 0.05 else None
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    asks = [(i, key(), at()) for i in range(120)]
    says = [(i, key(), at()) for i in range(60)] + [(3, "a", day), (3, "a", day)]
    left = spark.createDataFrame([*asks, asks[0]], "id long, k string, ts timestamp")
    right = spark.createDataFrame(says, "id long, k string, at timestamp")
    out = asof.as_of(left, right, "ts", "at", ["k"], seconds).collect()
    assert len(out) == 121
    for r in out:
        before = [(t, i) for i, k, t in says if k is not None and k == r.k and t is not None and r.ts is not None and t <= r.ts]
        assert (r.found and (r.found["at"], r.found["id"])) == (max(before) if before else None)
    assert asof.as_of(left.limit(0), right, "ts", "at", ["k"]).count() == 0
    assert asof.as_of(left, right.limit(0), "ts", "at", ["k"]).where(F.col("found").isNotNull()).count() == 0


def test_runs_are_found_once_for_each_expression(spark):
    """masks are made of distinct expressions, and rows meet their runs by a join."""
    rows = [(k, e) for k in range(40) for e in ("0 12 * * *", "nothing", None, "@daily")]
    found = schedules.due_runs(spark.createDataFrame(rows, "k int, cron string"), "cron", "2024-01-01 00:00:00", "2024-01-02 12:00:00")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert found.columns == ["k", "cron", "due"] and {(r.cron, r["count"]) for r in found.groupBy("cron").count().collect()} == {("0 12 * * *", 80), ("@daily", 40)}
