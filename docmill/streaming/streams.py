"""Structured Streaming: windows, incremental dedup, limiters and alerts with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.functions.hashing import content_hash


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def windowed(events: DataFrame, time_col: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling windows, for a batch or a stream."""
    marked = events.withWatermark(time_col, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time_col, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total")


def first_seen(docs: DataFrame, time_col: str, text_col: str, late: str = "1 day") -> DataFrame:
    """The first document of each content within the watermark."""
    return docs.withColumn("content_hash", content_hash(text_col)).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["content_hash"])


def cooldown_alerts(events: DataFrame, key: str, time_col: str, value: str, bound: float, seconds: float) -> DataFrame:
    """Alerts of a stream by key: over the bound, and ``seconds`` after the key last fired. The state is the time of the last alert."""
    kind = events.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        fired: list[tuple[float, float]] = []
        rows = pd.concat(list(batches)).sort_values("at")
        for at, v in zip(rows["at"], rows["v"]):
            if v > bound and (last is None or at - last >= seconds):
                fired.append((at, v))
                last = at
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame({key: [name[0]] * len(fired), "at": [f[0] for f in fired], "value": [f[1] for f in fired]})

    # Only what is over the bound is shuffled and held: a key's alerts of one trigger, not its events.
    timed = events.where(F.col(value) > bound).select(key, F.unix_micros(time_col).cast("double").alias("us"), F.col(value).cast("double").alias("v")).withColumn("at", F.col("us") / 1e6).drop("us")
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, value double", "last double", "append", "NoTimeout")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, into Parquet or a function of each batch; repeats start from the checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(sink).start() if callable(sink) else writer.format("parquet").start(sink)
