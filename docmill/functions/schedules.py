"""Cron expressions as columns: each row has its own expression.

A field becomes a bit mask, so whether it admits a value is a shift and the next admitted one is the lowest bit of what is left.
An expression that isn't one, or admits nothing, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import _col
from docmill.functions.times import ALIASES, FIELDS

#: Months that are looked at at once, and until one with an admitted day is found: from one 29 February to the next are eight years at most.
SOON, LATEST = 12, 97


def _set(bits: Column, n: Column) -> Column:
    return bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")))


def field_mask(field: Column, low: int, high: int) -> Column:
    """The values that a field admits as bits: ``*``, lists, ranges and steps in any combination; null if it is malformed or outside its range."""

    def item_mask(item: Column) -> Column:
        halves = F.split(item, "/", 2)
        span, step = halves[0], F.get(halves, F.lit(1))
        ends = F.split(span, "-", 2)
        begin = F.when(span == "*", low).otherwise(ends[0].try_cast("int"))
        last = F.when((span == "*") | (step.isNotNull() & (F.size(ends) == 1)), high).otherwise(F.get(ends, F.size(ends) - 1).try_cast("int"))
        by = F.when(step.isNull(), 1).otherwise(step.try_cast("int"))
        sound = (begin >= low) & (last <= high) & (begin <= last) & (by >= 1)
        return F.when(sound, F.aggregate(F.sequence(begin, last, by), F.lit(0).cast("long"), _set))

    return F.aggregate(F.split(field, ","), F.lit(0).cast("long"), lambda bits, item: bits.bitwiseOR(item_mask(item)))


def cron_masks(expression: Column | str) -> Column:
    """A struct of the five masks, minute to weekday (Sunday is 0); null if the expression isn't one."""
    text = F.trim(_col(expression))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    parts = F.split(F.coalesce(F.try_element_at(known, text), text), r"\s+")
    masks = [field_mask(F.get(parts, F.lit(k)), low, high).alias(name) for k, (name, low, high) in enumerate(FIELDS)]
    whole = F.size(parts) == len(FIELDS)
    for m in masks:
        whole = whole & m.isNotNull()
    return F.when(whole, F.struct(*masks))


def next_bit(mask: Column, least: Column) -> Column:
    """The lowest set bit of ``mask`` from ``least`` on; null if there is none."""
    left = F.call_function("shiftrightunsigned", mask, least.cast("int"))
    return F.when((least < 64) & (left != 0), least + F.bit_count(left.bitwiseAND(-left) - 1))


def admitted_days(masks: Column, first: Column) -> Column:
    """The days of a month, given its first date, that a schedule admits, as bits 1 to 31."""
    weekday = F.dayofweek(first) - 1
    weeks = masks["weekday"] * F.lit(sum(1 << (7 * k) for k in range(6)))
    by_weekday = F.shiftleft(F.call_function("shiftright", weeks, weekday), 1)
    in_month = F.call_function("shiftleft", F.lit(2).cast("long"), F.dayofmonth(F.last_day(first))) - 2
    days = masks["day"].bitwiseAND(by_weekday).bitwiseAND(in_month)
    month_ok = F.call_function("shiftright", masks["month"], F.month(first)).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.when(month_ok, days).otherwise(F.lit(0).cast("long"))


def next_day(masks: Column, date: Column) -> Column:
    """The first admitted date from ``date`` on."""
    first = F.trunc(date, "month")
    this = next_bit(admitted_days(masks, first), F.dayofmonth(date))

    def later(begin: int, end: int) -> Column:
        months = F.transform(F.sequence(F.lit(begin), F.lit(end)), lambda k: F.add_months(first, k))
        found = F.filter(months, lambda m: admitted_days(masks, m) != 0)
        month = F.get(found, F.lit(0))
        return F.date_add(month, (next_bit(admitted_days(masks, month), F.lit(1)) - 1).cast("int"))

    return F.when(this.isNotNull(), F.date_add(first, (this - 1).cast("int"))).otherwise(F.coalesce(later(1, SOON), later(SOON + 1, LATEST)))


def with_next_run(df: DataFrame, expression_col: str, time_col: str) -> DataFrame:
    """``df`` and ``next_run``, the first minute after its time that its own expression admits; null for null times and for expressions that admit nothing.

    Masks are made once for each distinct expression, and the next admitted day once for each distinct expression and date.
    """
    masks = df.select(F.col(expression_col).alias("_e")).distinct().where("_e IS NOT NULL").withColumn("_m", cron_masks("_e"))
    start = F.timestamp_add("MINUTE", F.lit(1), F.date_trunc("minute", F.col(time_col)))
    rows = df.withColumn("_at", start).withColumn("_date", F.to_date("_at"))
    days = rows.select(F.col(expression_col).alias("_e"), F.col("_date").alias("_d")).distinct().where("_d IS NOT NULL").join(masks.where("_m IS NOT NULL"), "_e")
    days = days.withColumn("_today", next_day(F.col("_m"), F.col("_d"))).withColumn("_after", next_day(F.col("_m"), F.date_add("_d", 1)))
    both = rows.join(days, (F.col(expression_col) == F.col("_e")) & (F.col("_date") == F.col("_d")), "left")
    hour, minute = F.hour("_at"), F.minute("_at")
    m = F.col("_m")
    same_hour = F.when(F.call_function("shiftright", m["hour"], hour).bitwiseAND(F.lit(1).cast("long")) == 1, hour * 60 + next_bit(m["minute"], minute))
    least = next_bit(m["minute"], F.lit(0))
    today = F.when(F.col("_today") == F.col("_date"), F.coalesce(same_hour, next_bit(m["hour"], hour + 1) * 60 + least))
    opening = next_bit(m["hour"], F.lit(0)) * 60 + least
    day = F.when(today.isNotNull(), F.col("_date")).when(F.col("_today") > F.col("_date"), F.col("_today")).otherwise(F.col("_after"))
    run = F.timestamp_add("MINUTE", F.coalesce(today, opening).cast("int"), day.cast(df.schema[time_col].dataType))
    return both.withColumn("next_run", run).drop("_at", "_date", "_e", "_d", "_m", "_today", "_after")


def due_runs(df: DataFrame, expression_col: str, start: str, end: str) -> DataFrame:
    """A row of ``df`` with ``due`` for every run of its expression after ``start`` up to ``end``, both timestamps. The runs are found once for each distinct expression."""
    rows = df.select(F.col(expression_col).alias("_e")).distinct().where("_e IS NOT NULL").withColumn("_m", cron_masks("_e")).where("_m IS NOT NULL")
    low, high = (F.lit(t).cast("timestamp") for t in (start, end))
    each = rows.withColumn("_d", F.explode(F.sequence(F.to_date(low), F.to_date(high))))
    m, day = F.col("_m"), F.col("_d")
    admits = lambda field, value: F.call_function("shiftright", m[field], value).bitwiseAND(F.lit(1).cast("long")) == 1
    each = each.where(admits("month", F.month(day)) & admits("day", F.dayofmonth(day)) & admits("weekday", F.dayofweek(day) - 1))
    hours = each.withColumn("_h", F.explode(F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: admits("hour", h))))
    minutes = hours.withColumn("_i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(59)), lambda i: admits("minute", i))))
    due = minutes.withColumn("due", F.timestamp_add("MINUTE", F.col("_h") * 60 + F.col("_i"), day.cast("timestamp")))
    due = due.where((F.col("due") > low) & (F.col("due") <= high)).select("_e", "due")
    return df.join(due, F.col(expression_col) == F.col("_e")).drop("_e")


def simple_next_run(expression: Column | str, last: Column | str) -> Column:
    """The next run of a simplified schedule: ``*/N`` minutes or hours after the last one, at a minute of each hour, or at a time of each day.

    Kept as they are: with a given minute field days, months and weekdays don't count; ``* H * * *`` runs each hour at minute H; a day alone
    means midnight of every day. Null where the expression isn't one.
    """
    at, parts = _col(last), F.split(F.trim(_col(expression)), r"\s+")
    minute, hour, day = (F.get(parts, F.lit(k)) for k in range(3))
    every = lambda c: F.substring(c, 3, 9).try_cast("int")
    after = lambda unit, n: F.when(n > 0, F.timestamp_add(unit, n, at))

    def at_minute(n: Column) -> Column:
        this = F.timestamp_add("MINUTE", n, F.date_trunc("hour", at))
        return F.when(n.between(0, 59), F.when(this > at, this).otherwise(F.timestamp_add("HOUR", F.lit(1), this)))

    def at_time(h: Column, m: Column) -> Column:
        this = F.timestamp_add("MINUTE", h * 60 + m, F.date_trunc("day", at))
        return F.when(h.between(0, 23) & m.between(0, 59), F.when(this > at, this).otherwise(F.timestamp_add("DAY", F.lit(1), this)))

    number = lambda c: c.try_cast("int")
    any_minute = F.when((hour == "*") & (day != "*"), at_time(F.lit(0), F.lit(0))).when(hour == "*", F.timestamp_add("MINUTE", F.lit(1), at))
    any_minute = any_minute.when(F.startswith(hour, F.lit("*/")), after("HOUR", every(hour))).otherwise(at_minute(number(hour)))
    run = F.when(F.startswith(minute, F.lit("*/")), after("MINUTE", every(minute))).when(minute == "*", any_minute)
    run = run.when(hour == "*", at_minute(number(minute))).otherwise(at_time(number(hour), number(minute)))
    return F.when(F.size(parts) == len(FIELDS), run)
