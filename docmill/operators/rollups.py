"""Roll-ups that are kept: states of keys and hours, to which new hours are added without a look at old rows.

Counts, sums and extremes merge exactly, distinct users by HyperLogLog sketches or, where the count has to be exact, as rows of their own, quantiles by KLL sketches. A report over any set of
hours merges states, a row for each key and hour, instead of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_states(df: DataFrame, time_col: str, by: list[str], value_col: str, user_col: str, failed: str = "false") -> DataFrame:
    """by, hour and the state of each key and hour; ``failed`` is an SQL condition. Rows without time have the hour null; null values count as rows only."""
    value = F.col(value_col).cast("double")
    return df.groupBy(*by, F.date_trunc("hour", F.col(time_col)).alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.expr(failed)).alias("failures"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.max_by(value, time_col).alias("latest"), F.max(time_col).alias("latest_at"), F.hll_sketch_agg(user_col).alias("users"), F.kll_sketch_agg_double(value).alias("values"),
    )


def merged_states(states: DataFrame, *by: str) -> DataFrame:
    """States of several hours as one state for each ``by``; ``hour`` can be one of them, so new rows of a stored hour merge into it."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("failures").alias("failures"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.max_by("latest", "latest_at").alias("latest"), F.max("latest_at").alias("latest_at"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("values").alias("values"),
    )


def with_new_hours(stored: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``stored`` and the states of new rows; hours that are in both are merged. Only states are read, never the rows behind them."""
    return merged_states(stored.unionByName(new), *by, "hour")


def hourly_users(df: DataFrame, time_col: str, by: list[str], user_col: str) -> DataFrame:
    """by, hour and the distinct users of each key and hour, a row each: what a report needs to count users exactly."""
    return df.where(F.col(user_col).isNotNull()).select(*by, F.date_trunc("hour", F.col(time_col)).alias("hour"), F.col(user_col).alias("user")).distinct()


def with_new_users(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new).distinct()


def report(states: DataFrame, *by: str, users: DataFrame | None = None) -> DataFrame:
    """n, failures, success_rate, total, mean, least, most, latest, users and median of merged states. Users are estimated from the sketches, or counted where their rows (``hourly_users``) are given."""
    merged = merged_states(states, *by)
    counted = F.hll_sketch_estimate("users")
    if users is not None:
        exact = users.select(F.struct(F.lit(0), *by).alias("_by"), "user").groupBy("_by").agg(F.count_distinct("user").alias("_users"))
        merged = merged.join(exact, F.struct(F.lit(0), *by).eqNullSafe(F.col("_by")), "left")
        counted = F.coalesce("_users", F.lit(0))
    rate = 100 * (F.col("n") - F.col("failures")) / F.col("n")
    return merged.select(
        *by, "n", "failures", rate.alias("success_rate"), "total", F.try_divide("total", "n_values").alias("mean"), "least", "most", "latest",
        counted.alias("users"), F.kll_sketch_get_quantile_double("values", F.lit(0.5)).alias("median"),
    )
