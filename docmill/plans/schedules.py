"""Queries of schedules that are data, and of as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import schedules
from docmill.operators import asof
from docmill.plans.base import query, table

CRONS = ("*/30 8-18 * * 1-5", "15 3 1 * *", "0 0 * * 0", "5,35 */6 10-20 1,3 *", "@daily", "0 12 29 2 *", "not a schedule")
SIMPLE = ("*/15 * * * *", "* */2 * * *", "* * * * *", "30 * * * *", "15 8 * * *", "* * 5 * *", "* 8 * * *")

#: Every minute that each expression admits.
ADMITTED = """
WITH m AS (SELECT range AS t FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '{end}', INTERVAL 1 MINUTE)),
ok AS (
  SELECT 0 AS k, t FROM m WHERE minute(t) IN (0, 30) AND hour(t) BETWEEN 8 AND 18 AND dayofweek(t) BETWEEN 1 AND 5
  UNION ALL SELECT 1, t FROM m WHERE minute(t) = 15 AND hour(t) = 3 AND day(t) = 1
  UNION ALL SELECT 2, t FROM m WHERE minute(t) = 0 AND hour(t) = 0 AND dayofweek(t) = 0
  UNION ALL SELECT 3, t FROM m WHERE minute(t) IN (5, 35) AND hour(t) % 6 = 0 AND day(t) BETWEEN 10 AND 20 AND month(t) IN (1, 3)
  UNION ALL SELECT 4, t FROM m WHERE minute(t) = 0 AND hour(t) = 0
  UNION ALL SELECT 5, t FROM m WHERE minute(t) = 0 AND hour(t) = 12 AND day(t) = 29 AND month(t) = 2
)
"""


def _of(expressions: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, expressions)), (F.col(key) % len(expressions) + 1).cast("int"))


@query(ADMITTED.format(end="2024-05-01") + "SELECT event_id, t AS next_run FROM (SELECT event_id, user_id % 7 AS k, date_trunc('minute', ts) AS minute_of FROM events) e ASOF LEFT JOIN ok ON e.k = ok.k AND minute_of < t")
def next_runs_of_schedules(spark, sf_dir):
    """The next run after each event of the schedule of its user."""
    events = table(spark, sf_dir, "events").withColumn("cron", _of(CRONS, "user_id"))
    return schedules.with_next_run(events, "cron", "ts").select("event_id", "next_run")


@query(ADMITTED.format(end="2024-01-15") + "SELECT c_custkey, t AS due FROM customer JOIN ok ON c_custkey % 7 = k WHERE t > TIMESTAMP '2024-01-07 23:00:00' AND t <= TIMESTAMP '2024-01-14 08:30:00'")
def due_runs(spark, sf_dir):
    """All runs of a week of the schedule of each customer."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", _of(CRONS, "c_custkey").alias("cron"))
    return schedules.due_runs(customers, "cron", "2024-01-07 23:00:00", "2024-01-14 08:30:00").select("c_custkey", "due")


@query("""WITH e AS (SELECT event_id, user_id % 7 AS k, ts, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d FROM events)
SELECT event_id, CASE k WHEN 0 THEN ts + INTERVAL 15 MINUTE WHEN 1 THEN ts + INTERVAL 2 HOUR WHEN 2 THEN ts + INTERVAL 1 MINUTE
  WHEN 3 THEN h + CASE WHEN h + INTERVAL 30 MINUTE > ts THEN INTERVAL 30 MINUTE ELSE INTERVAL 90 MINUTE END
  WHEN 4 THEN d + CASE WHEN d + INTERVAL 495 MINUTE > ts THEN INTERVAL 495 MINUTE ELSE INTERVAL 1935 MINUTE END
  WHEN 5 THEN d + INTERVAL 1 DAY
  ELSE h + CASE WHEN h + INTERVAL 8 MINUTE > ts THEN INTERVAL 8 MINUTE ELSE INTERVAL 68 MINUTE END END AS next_run FROM e""")
def simple_schedules(spark, sf_dir):
    """The next run after each event of the simplified schedule of its user."""
    return table(spark, sf_dir, "events").select("event_id", schedules.simple_next_run(_of(SIMPLE, "user_id"), F.col("ts")).alias("next_run"))


@query("""SELECT p.event_id, v.event_id AS view_id, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view_before_purchase(spark, sf_dir):
    """Each purchase with the last view of its user at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    of = lambda kind: events.where(F.col("event_type") == kind)
    found = asof.as_of(of("purchase"), of("view"), "ts", "ts", ["user_id"])
    return found.select("event_id", F.col("found.event_id").alias("view_id"), F.col("found.value").alias("value"))


@query("""SELECT r.event_id, c.event_id AS check_id, c.value AS score FROM (SELECT * FROM events WHERE event_type = 'signup') r
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') c ON r.ts >= c.ts""")
def reports_with_latest_check(spark, sf_dir):
    """Each report with the last check of all at or before it: no key, so time alone spreads the rows."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    of = lambda kind: events.where(F.col("event_type") == kind)
    found = asof.as_of(of("signup"), of("error"), "ts", "ts", [], 3600)
    return found.select("event_id", F.col("found.event_id").alias("check_id"), F.col("found.value").alias("score"))
