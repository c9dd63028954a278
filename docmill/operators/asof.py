"""As-of joins: each row with the latest one of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], seconds: int = 86_400) -> DataFrame:
    """``left`` and ``found``, a struct of the columns of the last row of ``right`` with the same ``by`` at or before its time; null if there is none.

    Both tables in one, sorted by time within a key and a span of ``seconds``: the last row of ``right`` so far is a running value.
    Where a span has none yet it is the last one of the spans before, a row each, so a key that holds a third of all rows is as many
    tasks as it has spans. Null keys match nothing, nor do null times; of several rows at one time the largest by its columns counts.
    """
    keys = [F.col(c).alias(f"_k{n}") for n, c in enumerate(by)]
    names = [f"_k{n}" for n in range(len(by))]
    found = F.struct(F.col(right_time).alias("_time"), F.struct(*right.columns).alias("row"))
    usable = right.where(F.col(right_time).isNotNull())
    for c in by:
        usable = usable.where(F.col(c).isNotNull())
    empty = left.limit(0).select(F.struct(*left.columns).alias("row")).schema["row"].dataType
    none = usable.limit(0).select(found.alias("found")).schema["found"].dataType
    asks = left.select(*keys, F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(none).alias("found"), F.lit(True).alias("_asks"))
    says = usable.select(*keys, F.col(right_time).alias("_at"), F.lit(None).cast(empty).alias("_left"), found.alias("found"), F.lit(False).alias("_asks"))
    rows = asks.unionByName(says).withColumn("_span", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / F.lit(seconds * 1_000_000)))
    inside = F.last("found", ignorenulls=True).over(Window.partitionBy(*names, "_span").orderBy("_at", "_asks", "found"))
    spans = rows.groupBy(*names, "_span").agg(F.max("found").alias("last"))
    before = Window.partitionBy(*names).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(before)).select(*(F.col(c).alias(f"{c}_c") for c in names), F.col("_span").alias("_span_c"), "carried")
    known = rows.withColumn("inside", inside).where("_asks")
    same = F.col("_span") == F.col("_span_c")
    for c in names:
        same = same & (F.col(c) == F.col(f"{c}_c"))
    out = known.join(carried.where("carried IS NOT NULL"), same, "left")
    sound = F.col("_at").isNotNull()
    for c in names:
        sound = sound & F.col(c).isNotNull()
    return out.select("_left.*", F.when(sound, F.coalesce("inside", "carried")["row"]).alias("found"))
