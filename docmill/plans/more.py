"""Further queries: statistics of alerts, queues and storage, term weights, checks of records, state changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import terms
from docmill.functions.text import STOP_WORDS
from docmill.operators import folds, monitoring, reports
from docmill.plans.base import query, table
from docmill.sources import sinks


@query("""SELECT CASE WHEN value > 80 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'info' END AS level, event_type AS rule, count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS active
  FROM events WHERE event_type IN ('error', 'signup') GROUP BY GROUPING SETS ((level), (rule))""")
def alert_stats(spark, sf_dir):
    level = F.when(F.col("value") > 80, "critical").when(F.col("value") > 40, "warning").otherwise("info")
    alerts = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).select(level.alias("level"), F.col("event_type").alias("rule"), "ts")
    return alerts.groupingSets([[F.col("level")], [F.col("rule")]], "level", "rule").agg(F.count("*").alias("total"), F.count_if(F.col("ts") > F.lit("2024-01-15").cast("timestamp")).alias("active"))


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY 1""")
def queue_stats(spark, sf_dir):
    names = {"P": "pending", "O": "running", "F": "completed"}
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", [*names]).count()
    return out.select("priority", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in names.items()))


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1048576.0, 2) AS mb FROM documents GROUP BY ROLLUP (source)")
def storage_stats(spark, sf_dir):
    return monitoring.storage(table(spark, sf_dir, "documents"), "source", F.octet_length("text"))


@query("SELECT count(*) AS sources, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (c_acctbal < 0) AS negative, count(DISTINCT c_mktsegment) AS segments, ceil(count(*) / 20.0)::BIGINT AS pages FROM customer")
def source_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.agg(F.count("*").alias("sources"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_distinct("c_mktsegment").alias("segments"), F.ceil(F.count("*") / 20).alias("pages"))


@query("SELECT c_custkey, o.n::VARCHAR AS n, CASE WHEN o.n IS NULL THEN 'no result' END AS error FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey")
def batch_results(spark, sf_dir):
    results = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("string").alias("n"))
    return monitoring.results_of(table(spark, sf_dir, "customer").select("c_custkey"), results, "c_custkey", "n")


@query("""WITH t AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, before, before IS NULL OR (before = 'signup' AND event_type IN ('view', 'click')) OR (before = 'view' AND event_type IN ('click', 'purchase', 'view')) AS allowed FROM t""")
def state_changes(spark, sf_dir):
    allowed = {"signup": ("view", "click"), "view": ("click", "purchase", "view")}
    return monitoring.transitions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], allowed).select("event_id", "before", "allowed")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 3600 SECOND")
def results_alive(spark, sf_dir):
    return monitoring.alive(table(spark, sf_dir, "events"), "ts", "2024-01-20 12:00:00", 3600).select("event_id")


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS ws FROM conversations),
p AS (SELECT conv_id, turn, ws, lag(ws) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM w)
SELECT conv_id, turn, round(coalesce(len(list_intersect(ws, prior)) / nullif(len(list_distinct(list_concat(ws, prior))), 0), 0), 9) AS similarity FROM p WHERE prior IS NOT NULL""")
def turn_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(terms.words("text")).alias("ws"))
    paired = rows.withColumn("prior", F.lag("ws").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("prior").isNotNull())
    return paired.select("conv_id", "turn", F.round(terms.jaccard(F.col("ws"), F.col("prior")), 9).alias("similarity"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) > 1 AND term NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with') GROUP BY ALL),
v AS (SELECT term, count(*) AS docs, sum(n) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 1000),
w AS (SELECT doc_id, term, n * ln(((SELECT count(*) FROM documents) + 1) / (docs + 1)) AS w FROM c JOIN v USING (term))
SELECT doc_id, count(*) AS terms, round(sum(x), 6) AS weight FROM (SELECT doc_id, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS x FROM w) GROUP BY doc_id""")
def term_weights(spark, sf_dir):
    weights = terms.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    return weights.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight"))


@query("SELECT doc_id, length(text) BETWEEN 100 AND 100000 AS fits, length(trim(text)) >= 10 AND source IS NOT NULL AND lang IS NOT NULL AS complete FROM documents")
def record_checks(spark, sf_dir):
    fits, complete = F.length("text").between(100, 100_000), (F.length(F.trim("text")) >= 10) & F.col("source").isNotNull() & F.col("lang").isNotNull()
    return table(spark, sf_dir, "documents").select("doc_id", fits.alias("fits"), complete.alias("complete"))


@query("""SELECT n_name, list_aggregate(list_sort(list_distinct(list_concat(array_agg(DISTINCT c_mktsegment), ['NATION', 'MACHINERY']))), 'string_agg', ',') AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def tag_sets(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tags = F.array_sort(F.array_union(F.collect_set("c_mktsegment"), F.array(F.lit("NATION"), F.lit("MACHINERY"))))
    return both.groupBy("n_name").agg(F.array_join(tags, ",").alias("tags"))


@query("""SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
  round(avg(value) FILTER (event_type <> 'error') * 1000, 6) AS response_ms, coalesce(round(sum(value) FILTER (event_type = 'purchase') / nullif(sum(value) FILTER (event_type = 'view'), 0), 6), 0) AS yield FROM events GROUP BY user_id""")
def request_stats(spark, sf_dir):
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")))
    failed = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("requests"), failed.alias("failures"), F.round(reports.rate(failed, F.count("*")), 6).alias("error_rate"),
        F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))) * 1000, 6).alias("response_ms"), F.coalesce(F.round(F.try_divide(of("purchase"), of("view")), 6), F.lit(0.0)).alias("yield"),
    )


@query()
def domain_then_user_limits(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    return folds.all_admit(events, [("event_type", folds.sliding_window(40 / 86_400, 86_400)), ("user_id", folds.least_gap(3600))], "ts", "event_id", "admitted").select("event_id", "admitted")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' AND coalesce(c_acctbal > 0, true)")
def enabled_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").withColumn("enabled", F.col("c_acctbal") > 0)
    return reports.enabled(reports.where_all(sources, c_mktsegment="MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT event_id, event_type || '.' || user_id AS metric FROM events WHERE event_type = 'click'")
def metrics_of_component(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("metric", F.concat_ws(".", "event_type", F.col("user_id").cast("string")))
    return reports.with_prefix(events, "metric", "click").select("event_id", "metric")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR o_orderdate >= TIMESTAMP '1997-01-01'")
def unexpired_tasks(spark, sf_dir):
    """Only finished orders expire, at their date."""
    orders = table(spark, sf_dir, "orders").withColumn("expires_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")))
    return reports.unexpired(orders, "expires_at", "1997-01-01").select("o_orderkey")


@query("""SELECT o_orderpriority AS job, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS successes, round(coalesce(min(o_totalprice), 0), 2) AS least, round(coalesce(avg(o_totalprice), 0), 4) AS mean,
  round(100 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success_rate FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def daily_report(spark, sf_dir):
    out = monitoring.daily_report(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "job"), "job", F.col("o_orderstatus") == "F", "o_totalprice")
    return out.withColumns({"least": F.round("least", 2), "mean": F.round("mean", 4), "success_rate": F.round("success_rate", 6)})


@query("""WITH r(rule, metric, bound, level, cooldown) AS (VALUES ('high_error', 'error', 30.0, 'error', 180::BIGINT), ('high_view', 'view', 85.0, 'critical', 60::BIGINT))
SELECT event_id, rule, level, cooldown FROM events JOIN r ON event_type = metric AND value > bound""")
def rule_breaches(spark, sf_dir):
    """Metrics over the bound of a rule of a table."""
    rules = spark.createDataFrame([("high_error", "error", 30.0, "error", 180), ("high_view", "view", 85.0, "critical", 60)], monitoring.RULES)
    return monitoring.breaches(table(spark, sf_dir, "events"), rules, "event_type").select("event_id", "rule", "level", "cooldown")


@query("""WITH a AS (SELECT user_id AS alert_id, min(ts) AS raised FROM events WHERE event_type = 'error' GROUP BY 1),
d AS (SELECT user_id AS alert_id, min(ts) FILTER (event_type = 'click') AS acknowledged_at, min(ts) FILTER (event_type = 'purchase' AND value > 30) AS resolved_at FROM events GROUP BY 1)
SELECT alert_id, acknowledged_at, resolved_at, CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN acknowledged_at IS NOT NULL THEN 'acknowledged' ELSE 'active' END AS status FROM a LEFT JOIN d USING (alert_id)""")
def alert_lifecycle(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "alert_id")
    alerts = events.where("event_type = 'error'").groupBy("alert_id").agg(F.min("ts").alias("raised")).drop("raised")
    action = F.when(F.col("event_type") == "click", "acknowledge").when((F.col("event_type") == "purchase") & (F.col("value") > 30), "resolve")
    return monitoring.alert_states(alerts, events.withColumn("action", action)).select("alert_id", "acknowledged_at", "resolved_at", "status")


@query("SELECT n_nationkey::VARCHAR AS id, (10 + coalesce(a, 0))::BIGINT AS collection_count, coalesce(g, 0)::BIGINT AS success_count, coalesce(b, 0)::BIGINT AS error_count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS a, count(*) FILTER (c_acctbal > 5000) AS g, count(*) FILTER (c_acctbal < 0) AS b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def source_task_counters(spark, sf_dir):
    """Counters of sources after a batch of tasks."""
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(10).cast("long").alias("collection_count"), F.lit(0).cast("long").alias("success_count"), F.lit(None).cast("long").alias("error_count"))
    status = F.when(F.col("c_acctbal") > 5000, "completed").when(F.col("c_acctbal") < 0, "failed").otherwise("running")
    return sinks.with_counters(sources, table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("source_id"), status.alias("status")))


@query("SELECT event_id, user_id, event_type AS operation, value FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT event_id, user_id, 'all', value FROM events")
def concatenated_series(spark, sf_dir):
    """The series of two operations and the one of all, one below the other."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("operation"), "value")
    return events.where(F.col("operation").isin("view", "click")).unionByName(events.withColumn("operation", F.lit("all")))


@query("""WITH t AS (SELECT o_orderpriority AS priority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, o_totalprice AS s FROM orders)
SELECT priority, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, 0::BIGINT AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  round(avg(s) FILTER (status IN ('completed', 'failed')), 4) AS mean_seconds, round(coalesce(100 * count(*) FILTER (status = 'completed') / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0), 0), 6) AS success_rate FROM t GROUP BY GROUPING SETS ((priority), ())""")
def queue_report(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), status.alias("status"), "o_totalprice")
    return monitoring.queue_report(tasks, "priority", "status", F.col("o_totalprice")).withColumns({c: F.round(c, n) for c, n in (("mean_seconds", 4), ("success_rate", 6))})


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) > 1 AND x NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with')) AS ws FROM conversations),
g AS (SELECT conv_id, turn, unnest(ws) AS term FROM w UNION ALL SELECT conv_id, turn, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END) FROM w)
SELECT term, count(*) AS n FROM g GROUP BY term HAVING count(*) > 5""")
def turn_terms(spark, sf_dir):
    """Words and pairs of words that occur more than five times over all turns."""
    own = F.filter(terms.words("text"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    each = table(spark, sf_dir, "conversations").select(F.explode(terms.grams(own, 2)).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n")).where("n > 5")


@query("""WITH c AS (SELECT event_type, count(*) FILTER (value > 95) AS u1, count(*) FILTER (value > 60) AS w1, count(*) FILTER (user_id IS NULL) AS u2, count(*) FILTER (value < 0.05) AS w3 FROM events GROUP BY event_type)
SELECT event_type, 'load' AS "check", CASE WHEN u1 > 0 THEN 'unhealthy' WHEN w1 > 0 THEN 'warning' ELSE 'healthy' END AS status, greatest(u1, w1) AS failing FROM c
UNION ALL SELECT event_type, 'owner', CASE WHEN u2 > 0 THEN 'unhealthy' ELSE 'healthy' END, u2 FROM c UNION ALL SELECT event_type, 'idle', CASE WHEN w3 > 0 THEN 'warning' ELSE 'healthy' END, w3 FROM c""")
def own_health_checks(spark, sf_dir):
    """Checks of one's own for each kind of event, a row each."""
    value = F.col("value")
    return monitoring.check_rows(table(spark, sf_dir, "events"), {"load": value > 60, "idle": value < 0.05}, {"load": value > 95, "owner": F.col("user_id").isNull()}, ("event_type",))


@query("SELECT event_id, round(value / 2, 6) AS half, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE END AS failed FROM events")
def custom_metrics(spark, sf_dir):
    """Metrics of own collectors beside the standard ones."""
    rows = monitoring.with_custom_metrics(table(spark, sf_dir, "events"), half=F.round(F.col("value") / 2, 6), failed=F.when(F.col("event_type") == "error", 1))
    of = lambda name: F.try_element_at("custom_metrics", F.lit(name)).alias(name)
    return rows.select("event_id", of("half"), of("failed"))
