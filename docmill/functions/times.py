"""Lenient timestamps, durations, cron expressions and retry delays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import _col

#: The fields of a cron expression with their ranges, and its short names.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))
ALIASES = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@hourly": "0 * * * *", "@every_minute": "* * * * *",
}
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss xx")


def lenient_timestamp(c: Column | str) -> Column:
    """The first form that fits, else null. A leading day of the week is ignored."""
    text = F.regexp_replace(_col(c), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))


def milliseconds(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / 1000


def retry_delay(attempt: Column | str, base: float, most: float) -> Column:
    """``base * 2 ** attempt``, at most ``most``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), _col(attempt)), F.lit(most))


@dataclass(frozen=True)
class Cron:
    """The values that each field admits; Sunday is weekday 0."""

    minute: tuple[int, ...]
    hour: tuple[int, ...]
    day: tuple[int, ...]
    month: tuple[int, ...]
    weekday: tuple[int, ...]


def parse_cron(expression: str) -> Cron:
    """``*``, lists, ranges and steps in any combination."""
    parts = ALIASES.get(expression.strip(), expression).split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"a cron expression has {len(FIELDS)} fields: {expression!r}")

    def values(part: str, low: int, high: int) -> tuple[int, ...]:
        found: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            first, _, last = span.partition("-")
            begin = low if span == "*" else int(first)
            end = high if span == "*" or step and not last else int(last or first)
            if not low <= begin <= end <= high:
                raise ValueError(f"{item!r} is outside {low}-{high}")
            found.update(range(begin, end + 1, int(step or 1)))
        return tuple(sorted(found))

    return Cron(*(values(part, low, high) for part, (_, low, high) in zip(parts, FIELDS)))


def next_runs(df: DataFrame, time_col: str, expression: str, days: int = 366) -> DataFrame:
    """``df`` and ``next_run``, the first minute after its time that the expression admits, within ``days``; null times have none.

    The next admitted day is found once for each distinct date and joined; hours and minutes of a day are a fixed list.
    """
    cron = parse_cron(expression)
    clock = F.lit([h * 60 + m for h in cron.hour for m in cron.minute])
    ok = lambda day: F.month(day).isin(list(cron.month)) & F.dayofmonth(day).isin(list(cron.day)) & (F.dayofweek(day) - 1).isin(list(cron.weekday))
    dates = df.select(F.to_date(time_col).alias("_date")).distinct()
    later_day = F.array_min(F.filter(F.sequence(F.date_add("_date", 1), F.date_add("_date", days)), ok))
    dates = dates.where(F.col("_date").isNotNull()).select("_date", ok(F.col("_date")).alias("_today"), later_day.alias("_day"))
    later = F.array_min(F.filter(clock, lambda m: m > F.hour(time_col) * 60 + F.minute(time_col)))
    at = F.when(F.col("_today") & later.isNotNull(), F.timestamp_add("MINUTE", later, F.date_trunc("day", F.col(time_col))))
    at = F.coalesce(at, F.timestamp_add("MINUTE", F.array_min(clock), F.col("_day").cast("timestamp")))
    joined = df.join(dates, F.to_date(df[time_col]) == F.col("_date"), "left")
    return joined.withColumn("next_run", at).drop("_date", "_today", "_day")
