"""Sharding by sampled splitters: ranges of about equal bytes, packed into shards of equal bytes.

The range key is a hash of the text, so equal texts lie in one range. A size-weighted sample of keys
gives the quantile boundaries of many more ranges than shards; exact sizes are then counted for each
range. A range that turns out overfull, in bytes or in rows, is subdivided at quantiles of a sample of its own
keys, until none is. A text whose copies alone outweigh a range becomes a range of its own and is subdivided by id
where a task would get too many of its rows; it leaves its shard only if it outweighs half a shard.
Ranges go to shards largest first, each to the emptiest shard. Slots number the rows of a shard without a
gap: the rows before a range plus the place within it, so no task sorts a whole shard. The number of ranges grows
with the rows (``RANGE_ROWS``), and the driver holds a few numbers for each range.

Defined cases: a null text has size 1 and the checksum of no bytes; repeated rows and repeated ids are separate
rows; an empty table gives an empty result; null ids are placed like others.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import materialize

#: Ranges for each shard at least, sampled keys for each range, and rows that a range and a part of one text have on average at most.
RANGES, SAMPLES, RANGE_ROWS, PART_ROWS = 64, 64, 100_000, 50_000
#: A range is overfull with so many times its share of bytes or rows.
OVERFULL = 2


def row_sizes(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """id, key, size and text_crc32 of each row, and what more is asked for."""
    text = F.encode(F.col(text_col), "UTF-8")
    return df.select(
        *more,
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("key"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )


def drawn(chance: Column, seed: int) -> Column:
    return (F.xxhash64("id", "key", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) < chance


def splitters(rows: DataFrame, total: int, ranges: int, seed: int) -> list[int]:
    """Quantile boundaries of a size-weighted key sample of ``ranges * SAMPLES`` rows on average."""
    chance = F.col("size") * F.lit(float(ranges * SAMPLES)) / F.lit(float(max(total, 1)))
    keys = np.sort(rows.where(drawn(chance, seed)).select("key").toPandas()["key"].to_numpy())
    return sorted(set(keys[np.arange(1, ranges) * len(keys) // ranges].tolist())) if len(keys) else []


def range_of(bounds: list[int]) -> Callable[[str], Column]:
    held = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def found(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, key.to_numpy(), side="right").astype(np.int32))

    return found


def subdivided(rows: DataFrame, bounds: list[int], total: int, count: int, ranges: int, seed: int) -> list[int]:
    """More boundaries where a range holds ``OVERFULL`` times its share of bytes or rows, at quantiles of a sample of its keys."""
    while True:
        sizes = rows.groupBy(range_of(bounds)("key").alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()  # a row for each range
        sizes["cuts"] = np.ceil(np.maximum(sizes["bytes"] * ranges / max(total, 1), sizes["n"] * ranges / max(count, 1))).astype(int)
        over = sizes[(sizes["cuts"] > OVERFULL) & (sizes["n"] > 1)]
        if over.empty:
            return bounds
        seed += 1
        share = np.minimum(over["cuts"] * SAMPLES / over["n"], 1.0)
        table = rows.sparkSession.createDataFrame([(int(r), float(s)) for r, s in zip(over["range"], share)], "range int, share double")
        sample = rows.withColumn("range", range_of(bounds)("key")).join(F.broadcast(table), "range").where(drawn(F.col("share"), seed)).select("range", "key").toPandas()
        new = set(bounds)
        for at, cuts in zip(over["range"], over["cuts"]):
            keys = np.sort(sample.loc[sample["range"] == at, "key"].to_numpy())
            new |= set(keys[np.arange(1, cuts) * len(keys) // cuts].tolist()) if len(keys) else set()
        if len(new) == len(bounds):
            return bounds
        bounds = sorted(new)


def to_shards(sizes: list[tuple[int, float]], shards: int) -> dict[int, int]:
    """Items, largest first, each to the shard with the least so far."""
    loads, placed = [(0, s) for s in range(shards)], {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[item] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def layout(rows: DataFrame, shards: int, seed: int) -> Callable[[DataFrame], DataFrame]:
    """From sizes, a function that adds range, part, shard and first (the slot of the part's first row) to rows with id, key and text_crc32."""
    spark = rows.sparkSession
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * max(RANGES, -(-count // (shards * RANGE_ROWS)))
    part_rows = min(PART_ROWS, max(64, count // ranges))
    # Fewer than ``ranges`` texts can outweigh a range.
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > total // ranges) | (F.col("n") > max(count // ranges, 1)))
    heavy = [(r.key, max(r.bytes * 2 * shards // max(total, 1), -(-r.n // part_rows)), r.bytes * 2 * shards > total) for r in heavy.sort("key").collect()]
    own = spark.createDataFrame([(k, i, parts, wide) for i, (k, parts, wide) in enumerate(heavy)], "key long, heavy int, parts long, wide boolean")
    others = rows.join(F.broadcast(own), "key", "left_anti")
    bounds = subdivided(others, splitters(rows, total, ranges, seed), total, count, ranges, seed)

    def ranged(given: DataFrame) -> DataFrame:
        alone = F.col("heavy").isNotNull()
        at = F.when(alone, F.lit(len(bounds) + 1) + F.col("heavy")).otherwise(range_of(bounds)("key"))
        part = F.when(alone, F.expr("pmod(xxhash64(id, text_crc32), parts)")).otherwise(F.lit(0)).cast("long")
        return given.join(F.broadcast(own), "key", "left").withColumn("range", at).withColumn("part", part).withColumn("wide", F.coalesce("wide", F.lit(False))).drop("heavy", "parts")

    # About one for each range, and one for each part of a heavy text.
    parts = ranged(rows).groupBy("range", "part", "wide").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas().sort_values(["range", "part"], ignore_index=True)
    parts["item"] = np.where(parts["wide"], np.arange(len(parts)), -1 - parts["range"]) if len(parts) else []
    placed = to_shards(list(parts.groupby("item")["bytes"].sum().items()), shards)
    parts["shard"] = [placed[i] for i in parts["item"]]
    parts["first"] = parts.groupby("shard")["n"].cumsum() - parts["n"]
    at = spark.createDataFrame([tuple(map(int, r)) for r in parts[["range", "part", "shard", "first"]].itertuples(index=False)], "range int, part long, shard int, first long")
    return lambda given: ranged(given).join(F.broadcast(at), ["range", "part"]).drop("wide")


#: The order of rows in a part.
ORDER = ("key", "id", "text_crc32", "size")


def assign(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row."""
    rows = materialize(row_sizes(df, id_col, text_col), "sizes")
    nth = F.row_number().over(Window.partitionBy("range", "part").orderBy(*ORDER))
    return layout(rows, shards, seed)(rows).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + nth - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> None:
    """Write the rows, each once, as one folder ``_shard=N`` a shard, in files that follow its slots."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    located = layout(materialize(row_sizes(df, id_col, text_col), "sizes"), shards, seed)(row_sizes(df, id_col, text_col, whole))
    order = ["_shard", "first", *ORDER]
    sorted_rows = located.withColumnRenamed("shard", "_shard").repartitionByRange(shards * 4, *order).sortWithinPartitions(*order)
    sorted_rows.select("row.*", "_shard").write.partitionBy("_shard").parquet(path)
