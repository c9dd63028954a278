"""Filters, pages, counts and rates of the operational reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def where_all(df: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every value that is given; None means no condition."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in equal.items() if v is not None), df)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by a space, hold ``query`` in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def since(df: DataFrame, time_col: str, asof: str, interval: str) -> DataFrame:
    """Rows from ``interval`` before ``asof`` on."""
    return df.where(F.col(time_col) >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {interval}"))


def on_day(df: DataFrame, time_col: str, day: str) -> DataFrame:
    """A half-open range, which reaches the scan."""
    start = F.lit(day).cast("date")
    return df.where((F.col(time_col) >= start.cast("timestamp")) & (F.col(time_col) < F.date_add(start, 1).cast("timestamp")))


def counts_when(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Rows and rows that meet each condition, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one id; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def enabled(df: DataFrame, flag: str = "enabled") -> DataFrame:
    """Rows whose flag isn't false; a flag that is null, or a column that is missing, counts as true."""
    return df.where(F.coalesce(F.col(flag), F.lit(True))) if flag in df.columns else df


def with_prefix(df: DataFrame, key: str, component: str) -> DataFrame:
    """Rows of one component by the key ``component.metric``."""
    return df.where(F.startswith(F.col(key), F.lit(f"{component}.")))


def unexpired(df: DataFrame, time_col: str, asof: str) -> DataFrame:
    """Rows that never expire (null) or haven't yet."""
    return df.where(F.col(time_col).isNull() | (F.col(time_col) >= F.lit(asof).cast("timestamp")))


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type and nullable of every column, in order: metadata alone, no table is read."""
    rows = [(name, at, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for at, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")


def rate(part: Column | str, whole: Column | str) -> Column:
    """Percent; null where the whole is 0."""
    return F.try_divide(part, whole) * 100


def rate_or_zero(part: Column | str, whole: Column | str) -> Column:
    """Percent; 0 where nothing has run."""
    return F.coalesce(rate(part, whole), F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """0 for what is null or infinite, such as the least of nothing."""
    return F.when(value.isNotNull() & (F.abs(value) != float("inf")), value).otherwise(F.lit(0.0))


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key is an orphan."""
    return df.join(parents, df[key] == parents[parent_key], "left_anti")


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)


def last_change(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: the change with the highest ``order``, else the one whose values come last as JSON, so the result never depends on the order of rows."""
    names = [c for c in changes.columns if c != key]
    whole = F.struct(*names)
    return changes.groupBy(key).agg(F.max_by(whole, F.col(order) if order else F.to_json(whole)).alias("_it")).select(key, *(F.col("_it")[c].alias(c) for c in names)) if names else changes.distinct()


def updated(df: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``df`` with the non-null values of ``changes`` in their place, for keys that it has. Of several changes of one key the last counts (``last_change``)."""
    names = [c for c in changes.columns if c != key and c in df.columns]
    new = last_change(changes, key, order).select(F.col(key), *(F.col(c).alias(f"__{c}") for c in names))
    return df.join(new, key, "left").select(*((F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in names else F.col(c)) for c in df.columns))
