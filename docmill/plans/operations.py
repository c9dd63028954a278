"""Queries over events, orders and customers in the roles of metrics, tasks and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import times
from docmill.operators import folds, monitoring, reports

from docmill.plans.base import ORACLE, QUERIES, query, table
from docmill.streaming import streams

ASOF = "2024-01-20 12:00:00"


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large, count(DISTINCT user_id) AS users,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS last_day FROM events""")
def conditional_counts(spark, sf_dir):
    recent = F.col("ts").between(F.lit(ASOF).cast("timestamp") - F.expr("INTERVAL 24 HOURS"), F.lit(ASOF).cast("timestamp"))
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"),
        F.count_distinct("user_id").alias("users"), F.count_if(recent).alias("last_day"),
    )


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-19 12:00:00'")
def events_since(spark, sf_dir):
    return reports.since(table(spark, sf_dir, "events"), "ts", ASOF, "24 HOURS").select("event_id", "ts", "event_type")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' GROUP BY event_type")
def events_today(spark, sf_dir):
    return reports.on_day(table(spark, sf_dir, "events"), "ts", "2024-01-20").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success_rate
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def success_rate_by_segment(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = reports.counts_when(both, ["c_mktsegment"], finished=F.col("o_orderstatus") == "F")
    return out.withColumn("success_rate", F.round(reports.rate("finished", "total"), 6))


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value > 10) AS successes, round(avg(value), 6) AS avg_duration, min(value) AS min_duration, max(value) AS max_duration,
  round(count(*) FILTER (value > 10) / count(*), 6) AS success_rate FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def component_performance(spark, sf_dir):
    out = monitoring.per_operation(table(spark, sf_dir, "events"), "event_type", F.col("value") > 10, "value")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_duration", "success_rate")})


@query("""SELECT o_orderpriority AS task, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS pending,
  round(sum(o_totalprice) FILTER (o_orderstatus IN ('F', 'O')), 2) AS total_time, min(o_totalprice) FILTER (o_orderstatus IN ('F', 'O')) AS min_time,
  round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O')), 6) AS success_rate FROM orders GROUP BY 1""")
def task_metrics(spark, sf_dir):
    done = F.col("o_orderstatus").isin("F", "O")
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(
        F.count("*").alias("total"), of("F").alias("success"), of("O").alias("failed"), of("P").alias("pending"),
        F.round(F.sum(F.when(done, F.col("o_totalprice"))), 2).alias("total_time"), F.min(F.when(done, F.col("o_totalprice"))).alias("min_time"),
        F.round(reports.rate(of("F"), F.count_if(done)), 6).alias("success_rate"),
    )


@query("SELECT event_type, round(avg(value), 6) AS avg_value, max(value) AS max_value, min(value) AS min_value, arg_max(value, ts) AS current_value FROM events GROUP BY event_type")
def perf_summary_current(spark, sf_dir):
    out = monitoring.summary(table(spark, sf_dir, "events"), ["event_type"], "value", "ts")
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS nth FROM events QUALIFY nth <= 5")
def last_n_per_key(spark, sf_dir):
    return reports.last_n(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 50")
def pending_tasks(spark, sf_dir):
    pending = reports.where_all(table(spark, sf_dir, "orders"), o_orderstatus="P").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return reports.page(pending, [F.desc("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 50)


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50")
def queue_order(spark, sf_dir):
    pending = reports.where_all(table(spark, sf_dir, "orders"), o_orderstatus="P").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return reports.page(pending, [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 50)


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON n_nationkey = c_nationkey GROUP BY n_name")
def counts_over_domain(spark, sf_dir):
    nations, rich = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    counts = rich.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return monitoring.over_domain(counts, nations.select("n_nationkey"), "n_nationkey", "n").join(nations, "n_nationkey").select("n_name", "n")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def sources_without_tasks(spark, sf_dir):
    """Customers without a pending order."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return reports.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), pending, "c_custkey", "o_custkey")


@query("""SELECT event_type, 'c' || (user_id % 10) AS component, count(*) AS n FROM (SELECT event_type, user_id FROM events WHERE event_type IN ('error', 'signup'))
  GROUP BY GROUPING SETS ((event_type), ('c' || (user_id % 10)))""")
def error_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).withColumn("component", F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")))
    sets = events.groupingSets([[F.col("event_type")], [F.col("component")]], "event_type", "component")
    return sets.agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id, CASE WHEN value > 90 THEN 'unhealthy' WHEN value > 60 THEN 'warning' ELSE 'healthy' END AS status FROM events)
SELECT user_id, CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'warning') THEN 'warning' WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'unknown' END AS status FROM c GROUP BY user_id""")
def health_rollup(spark, sf_dir):
    checks = table(spark, sf_dir, "events")
    status = F.when(F.col("value") > 90, "unhealthy").when(F.col("value") > 60, "warning").otherwise("healthy")
    return checks.select("user_id", status.alias("status")).groupBy("user_id").agg(monitoring.health().alias("status"))


@query("""WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS c, max(value) FILTER (event_type = 'click') AS m, 100.0 * count(*) FILTER (event_type = 'error') / count(*) AS e FROM events GROUP BY user_id),
s AS (SELECT user_id, (CASE WHEN c IS NULL THEN 0 WHEN c >= 90 THEN 1 WHEN c >= 80 THEN 0.8 WHEN c >= 70 THEN 0.6 ELSE 0 END * 0.3::DOUBLE + CASE WHEN m IS NULL THEN 0 WHEN m >= 95 THEN 1 WHEN m >= 85 THEN 0.8 WHEN m >= 75 THEN 0.6 ELSE 0 END * 0.2::DOUBLE
 + CASE WHEN e >= 20 THEN 1 WHEN e >= 10 THEN 0.8 WHEN e >= 5 THEN 0.6 ELSE 0 END * 0.3::DOUBLE) / (CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN m IS NULL THEN 0 ELSE 0.2::DOUBLE END + 0.3::DOUBLE) AS score FROM m)
SELECT user_id, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.8 THEN 'critical' WHEN round(score, 9) >= 0.6 THEN 'warning' WHEN round(score, 9) >= 0.3 THEN 'normal' ELSE 'healthy' END AS state FROM s""")
def adaptive_state(spark, sf_dir):
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    metrics = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(of("view")).alias("c"), F.max(of("click")).alias("m"), (F.count_if(F.col("event_type") == "error") * 100.0 / F.count("*")).alias("e"))
    scored = metrics.withColumn("score", F.round(monitoring.system_score(cpu_usage=F.col("c"), memory_usage=F.col("m"), error_rate=F.col("e")), 9))
    return scored.select("user_id", F.round("score", 6).alias("score"), monitoring.system_state(F.col("score")).alias("state"))


@query("""SELECT event_id, CASE WHEN value > 90 THEN 'critical' WHEN value > 80 THEN 'warning' ELSE 'healthy' END AS band,
  list_aggregate(list_filter([CASE WHEN value > 80 THEN 'cpu' END, CASE WHEN value > 85 THEN 'memory' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS issues FROM events""")
def status_bands(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", monitoring.band(v, 80, 90).alias("band"), F.nullif(F.array_join(monitoring.issues(cpu=(v, 80), memory=(v, 85)), ","), F.lit("")).alias("issues"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k LONG")["k"].alias("k")).where("k > 50")


@query("""SELECT event_id, round(least(2.0 * power(2, user_id % 8), 60.0), 6) AS delay FROM events""")
def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(times.retry_delay(F.col("user_id") % 8, 2.0, 60.0), 6).alias("delay"))


@query("""WITH m AS (SELECT range AS t FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2025-03-01', INTERVAL 15 MINUTE)),
ok AS (SELECT t FROM m WHERE minute(t) IN (0, 30) AND hour(t) BETWEEN 8 AND 18 AND dayofweek(t) BETWEEN 1 AND 5)
SELECT event_id, t AS next_run FROM (SELECT event_id, date_trunc('minute', ts) AS minute_of FROM events) ASOF JOIN ok ON minute_of < t""")
def cron_next(spark, sf_dir):
    return times.next_runs(table(spark, sf_dir, "events"), "ts", "*/30 8-18 * * 1-5").select("event_id", "next_run")


def _folded(rule, value: str = "value"):
    def run(spark, sf_dir):
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
        return folds.fold(events, "user_id", "ts", "event_id", value, rule, "admitted").select("event_id", "admitted")

    return run


def _recursive(start: str, step: str, columns: str) -> str:
    """A fold by user in SQL: events in order, one step each."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, {start} FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, {step} FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, {columns} FROM r"""


#: Users have an event in about every few hours, so windows here are hours and days.
QUERIES["token_bucket"] = _folded(folds.token_bucket(1 / 18_000, 2))
ORACLE["token_bucket"] = _recursive(
    "sec AS last, 1.0::DOUBLE AS tokens, true AS admitted",
    "e.sec, least(2.0, r.tokens + (e.sec - r.last) * (1 / 18000.0)) - CASE WHEN least(2.0, r.tokens + (e.sec - r.last) * (1 / 18000.0)) >= 1 THEN 1 ELSE 0 END, least(2.0, r.tokens + (e.sec - r.last) * (1 / 18000.0)) >= 1",
    "admitted",
)
QUERIES["leaky_bucket"] = _folded(folds.leaky_bucket(1 / 18_000, 2))
ORACLE["leaky_bucket"] = _recursive(
    "sec AS last, 1.0::DOUBLE AS volume, true AS admitted",
    "e.sec, greatest(0.0, r.volume - (e.sec - r.last) * (1 / 18000.0)) + CASE WHEN greatest(0.0, r.volume - (e.sec - r.last) * (1 / 18000.0)) < 2 THEN 1 ELSE 0 END, greatest(0.0, r.volume - (e.sec - r.last) * (1 / 18000.0)) < 2",
    "admitted",
)
QUERIES["fixed_window_limiter"] = _folded(folds.fixed_window(3.0 / 86_400, 86_400))
ORACLE["fixed_window_limiter"] = _recursive(
    "sec AS opened, 1 AS used, true AS admitted",
    "CASE WHEN e.sec - r.opened >= 86400 THEN e.sec ELSE r.opened END, CASE WHEN e.sec - r.opened >= 86400 THEN 1 ELSE least(r.used + 1, 3) END, e.sec - r.opened >= 86400 OR r.used < 3",
    "admitted",
)
QUERIES["sliding_window_limiter"] = _folded(folds.sliding_window(3.0 / 86_400, 86_400))
ORACLE["sliding_window_limiter"] = _recursive(
    "[sec] AS log, true AS admitted",
    "CASE WHEN len(list_filter(r.log, lambda x: e.sec - x < 86400)) < 3 THEN list_append(list_filter(r.log, lambda x: e.sec - x < 86400), e.sec) ELSE list_filter(r.log, lambda x: e.sec - x < 86400) END, len(list_filter(r.log, lambda x: e.sec - x < 86400)) < 3",
    "admitted",
)
QUERIES["least_gap_limiter"] = _folded(folds.least_gap(36_000))
ORACLE["least_gap_limiter"] = _recursive("sec AS last, true AS admitted", "CASE WHEN e.sec - r.last >= 36000 THEN e.sec ELSE r.last END, e.sec - r.last >= 36000", "admitted")
QUERIES["alerts_cooldown"] = _folded(folds.cooldown(20.0, 86_400))
ORACLE["alerts_cooldown"] = _recursive(
    "CASE WHEN value > 20 THEN sec END AS last, value > 20 AS admitted",
    "CASE WHEN e.value > 20 AND (r.last IS NULL OR e.sec - r.last >= 86400) THEN e.sec ELSE r.last END, e.value > 20 AND (r.last IS NULL OR e.sec - r.last >= 86400)",
    "admitted",
)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def sessions(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


@query("SELECT user_id, arg_max(event_type, ts) AS state, max(ts) AS at, count(*) AS changes FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("state"), F.max("ts").alias("at"), F.count("*").alias("changes"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("count_order"),
    )


@query("""SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp"))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, arg_min(role, turn) AS first_role, max(length(text)) AS longest FROM conversations GROUP BY conv_id""")
def conversation_stats(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.min_by("role", "turn").alias("first_role"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'failed' WHEN value > 50 THEN 'completed' WHEN value > 10 THEN 'running' ELSE 'pending' END AS status FROM events""")
def task_status(spark, sf_dir):
    done, begun = (F.when(F.col("value") > bound, F.col("ts")) for bound in (50, 10))
    return table(spark, sf_dir, "events").select("event_id", monitoring.task_status(begun, done, F.when(F.col("event_type") == "error", F.lit("e"))).alias("status"))


@query("""WITH d AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors)
UNPIVOT d ON COLUMNS(*) INTO NAME what VALUE n""")
def overview(spark, sf_dir):
    tables = {"documents": None, "pages": None, "labels": None, "errors": "event_type = 'error'"}
    out = None
    for what, condition in tables.items():
        rows = table(spark, sf_dir, "events" if condition else what)
        one = (rows.where(condition) if condition else rows).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_of_customer, lag(o_totalprice) OVER w AS price_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def order_windows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.first("o_orderkey").over(w).alias("first_of_customer"), F.lag("o_totalprice").over(w).alias("price_before"))
