"""Bands, roll-ups and scores over metrics, tasks and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.reports import finite_or_zero, rate_or_zero

#: Warning, critical and emergency bounds and the weight of each metric.
THRESHOLDS = {
    "cpu_usage": (70.0, 80.0, 90.0, 0.3),
    "memory_usage": (75.0, 85.0, 95.0, 0.2),
    "error_rate": (5.0, 10.0, 20.0, 0.3),
    "response_time": (5.0, 10.0, 30.0, 0.2),
}
#: Classes of errors, in order of precedence.
ERROR_CLASSES = (
    ("network", ("ConnectionError", "TimeoutError", "HTTPError", "URLError")),
    ("filesystem", ("OSError", "IOError", "FileNotFoundError", "PermissionError")),
    ("validation", ("ValueError", "TypeError", "KeyError", "ValidationError")),
    ("database", ("OperationalError", "IntegrityError", "DatabaseError")),
)


def summary(df: DataFrame, by: list[str], value: str, time: str) -> DataFrame:
    """Mean, extremes and the latest value of a series."""
    return df.groupBy(*by).agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.max_by(value, time).alias("current_value"))


def per_operation(df: DataFrame, operation: str, ok: Column, duration: str) -> DataFrame:
    """Count, successes, rate and durations of each operation, and of all together (null operation)."""
    out = df.withColumn("_ok", ok).groupingSets([[operation], []], operation)
    done = out.agg(F.count("*").alias("total"), F.count_if("_ok").alias("successes"), F.avg(duration).alias("avg_duration"), F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"))
    return done.withColumn("success_rate", F.col("successes") / F.col("total"))


def health(status: str = "status") -> Column:
    """Aggregate: any unhealthy, else any warning, else all healthy, else unknown; no checks are unknown."""
    n = F.count("*")
    return F.when(F.count_if(F.col(status) == "unhealthy") > 0, "unhealthy").when(F.count_if(F.col(status) == "warning") > 0, "warning").when((n > 0) & (F.count_if(F.col(status) == "healthy") == n), "healthy").otherwise("unknown")


def metric_score(name: str, value: Column) -> Column:
    warning, critical, emergency, _ = THRESHOLDS[name]
    return F.when(value >= emergency, 1.0).when(value >= critical, 0.8).when(value >= warning, 0.6).otherwise(0.0)


def system_score(**metrics: Column) -> Column:
    """Weighted mean of the scores of the metrics that are present; 0 without any."""
    total = reduce(lambda a, b: a + b, (F.when(m.isNotNull(), metric_score(n, m) * THRESHOLDS[n][3]).otherwise(0.0) for n, m in metrics.items()))
    weight = reduce(lambda a, b: a + b, (F.when(m.isNotNull(), THRESHOLDS[n][3]).otherwise(0.0) for n, m in metrics.items()))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def system_state(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "warning").when(score >= 0.3, "normal").otherwise("healthy")


def band(value: Column, warning: float, critical: float) -> Column:
    return F.when(value > critical, "critical").when(value > warning, "warning").otherwise("healthy")


def issues(**over: tuple[Column, float]) -> Column:
    """Names of the values that are over their bound."""
    return F.array_compact(F.array(*(F.when(value > bound, F.lit(name)) for name, (value, bound) in over.items())))


def task_status(started: Column, completed: Column, error: Column) -> Column:
    return F.when(completed.isNotNull() & error.isNotNull(), "failed").when(completed.isNotNull(), "completed").when(started.isNotNull(), "running").otherwise("pending")


def error_class(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, names in ERROR_CLASSES:
        out = out.when(name.isin(*names), kind)
    return out.otherwise("unknown")


def over_domain(counts: DataFrame, domain: DataFrame, key: str, count: str) -> DataFrame:
    """Counts of every member of the domain, 0 where there is none."""
    return domain.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count))


#: The states of a task and those that may follow.
TRANSITIONS = {
    "pending": ("running", "cancelled"),
    "running": ("success", "failed", "cancelled", "timeout", "retrying"),
    "retrying": ("running", "failed", "cancelled"),
    "failed": ("retrying",),
    "timeout": ("retrying",),
}


def transitions(df: DataFrame, key: str, state: str, order: list[str], allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``df`` with the state before and whether the change is allowed; the first state always is."""
    from pyspark.sql import Window

    out = df.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))
    ok = F.col("before").isNull()
    for old, new in (TRANSITIONS if allowed is None else allowed).items():
        ok = ok | ((F.col("before") == old) & F.col(state).isin(*new))
    return out.withColumn("allowed", ok)


def alive(df: DataFrame, time: str, asof: str, ttl_seconds: int) -> DataFrame:
    """Rows that are not older than their time to live."""
    return df.where(F.col(time) > F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def storage(df: DataFrame, folder: str, size: Column) -> DataFrame:
    """Files, bytes and MB of each folder, and of all (null folder)."""
    out = df.withColumn("_bytes", size).rollup(folder).agg(F.count("*").alias("files"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("mb", F.round(F.col("bytes") / (1024 * 1024), 2))


def results_of(ids: DataFrame, results: DataFrame, key: str, value: str, message: str = "no result") -> DataFrame:
    """Every id with its value, or else an error."""
    found = ids.join(results.select(key, value), key, "left")
    return found.withColumn("error", F.when(F.col(value).isNull(), F.lit(message)))


#: Predefined alert rules by name: metric, the value over which it fires, level and cooldown in seconds.
ALERT_RULES = (
    ("high_cpu_usage", "cpu_percent", 80.0, "warning", 300),
    ("high_memory_usage", "memory_percent", 85.0, "warning", 300),
    ("low_disk_space", "disk_usage_percent", 90.0, "critical", 600),
    ("high_error_rate", "error_rate", 10.0, "error", 180),
    ("service_unavailable", "service_unavailable", 0.0, "critical", 60),
)
RULES = "rule string, metric string, bound double, level string, cooldown long"


def alert_rules(spark: SparkSession, *more: tuple[str, str, float, str, int]) -> DataFrame:
    """The table of alert rules; a later rule of a name replaces an earlier one."""
    return spark.createDataFrame([*{r[0]: r for r in (*ALERT_RULES, *more)}.values()], RULES)


def breaches(metrics: DataFrame, rules: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Rows of a metric table that break a rule, with the rule, its level and cooldown. The rule table is small and joined by metric."""
    named = metrics.withColumnRenamed(metric, "_metric")
    met = named.join(rules, (F.col("_metric") == F.col("metric")) & (F.col(value) > F.col("bound")))
    return met.drop("metric").withColumnRenamed("_metric", metric)


def breaches_of(metrics: DataFrame, condition: str, rule: str, level: str = "warning", cooldown: int = 300) -> DataFrame:
    """The same for a rule given as a SQL condition over a table with a column for each metric."""
    return metrics.where(F.expr(condition)).withColumns({"rule": F.lit(rule), "level": F.lit(level), "cooldown": F.lit(cooldown)})


def alert_states(alerts: DataFrame, events: DataFrame, key: str = "alert_id", action: str = "action", time: str = "ts") -> DataFrame:
    """``alerts`` with status and the times at which they were acknowledged and resolved, from a log of actions.

    An alert is resolved once any action resolves it, else acknowledged once one acknowledges it, else active.
    """
    of = lambda kind: F.min(F.when(F.col(action) == kind, F.col(time)))
    done = events.groupBy(key).agg(of("acknowledge").alias("acknowledged_at"), of("resolve").alias("resolved_at"))
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("active")
    return alerts.join(done, key, "left").withColumn("status", status)


def daily_report(runs: DataFrame, job: str, ok: Column, duration: str) -> DataFrame:
    """For each job, and for all (null job): runs, successes, their rate (0 when never run), and least (0 without one) and mean duration."""
    sets = runs.withColumn("_ok", ok).groupingSets([[F.col(job)], []], job)
    out = sets.agg(F.count("*").alias("runs"), F.count_if("_ok").alias("successes"), finite_or_zero(F.min(duration)).alias("least"), finite_or_zero(F.avg(duration)).alias("mean"))
    return out.withColumn("success_rate", rate_or_zero("successes", "runs"))


def queue_report(tasks: DataFrame, by: str, status: str, seconds: Column) -> DataFrame:
    """For each type or priority, and for all (null): tasks by state, mean seconds of the finished ones and their success rate (0 without one)."""
    of = lambda *kinds: F.count_if(F.col(status).isin(*kinds))
    out = tasks.withColumn("_seconds", F.when(F.col(status).isin("completed", "failed"), seconds)).groupingSets([[F.col(by)], []], by)
    return out.agg(
        F.count("*").alias("total"), of("pending").alias("pending"), of("running").alias("running"), of("completed").alias("completed"), of("failed").alias("failed"),
        F.avg("_seconds").alias("mean_seconds"), rate_or_zero(of("completed"), of("completed", "failed")).alias("success_rate"),
    )


def check_rows(df: DataFrame, warning: dict[str, Column], unhealthy: dict[str, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, check, status and failing of own health checks, each a condition of rows that fail it: the more serious condition that any row meets decides.

    All checks are counted in one aggregate; a check that is in one of the two dictionaries only has no other level. An empty table is healthy; conditions that are null don't count.
    """
    unhealthy = unhealthy or {}
    names = sorted({*warning, *unhealthy})
    counted = [F.count_if(conditions[name]).alias(f"_{level}{k}") for k, name in enumerate(names) for level, conditions in (("w", warning), ("u", unhealthy)) if name in conditions]
    sums = df.groupBy(*by).agg(F.count("*").alias("_n"), *counted)

    def row(k: int, name: str) -> Column:
        bad, soft = (F.col(f"_{level}{k}") if name in conditions else F.lit(0).cast("long") for level, conditions in (("u", unhealthy), ("w", warning)))
        return F.struct(F.lit(name).alias("check"), F.when(bad > 0, "unhealthy").when(soft > 0, "warning").otherwise("healthy").alias("status"), F.greatest(bad, soft).alias("failing"))

    return sums.select(*by, F.explode(F.array(*(row(k, name) for k, name in enumerate(names)))).alias("c")).select(*by, "c.*")


def with_custom_metrics(df: DataFrame, **collectors: Column) -> DataFrame:
    """``df`` with ``custom_metrics``, a map of what own collectors, any columns, give for each row; nulls are left out."""
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), value.cast("double").alias("value")) for name, value in collectors.items()))
    return df.withColumn("custom_metrics", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
