"""Limiters, cooldowns and results with a time to live on a live stream, with state in RocksDB.

The rules are those of ``operators.folds``: a key's rule is rebuilt from its state, steps through the new rows and its state is stored
again, so a stream that is stopped and started anew goes on where it was and gives the rows of the batch fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docmill.operators.folds import Rule

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory: keyed state of any number of keys lies in RocksDB and its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _filed(key: str) -> Column:
    """The key as text that is never null: rows of a null key must not mix with others in a Python worker."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_key")


def _key_of(stream: DataFrame, key: str) -> Column:
    return F.when(F.col("_key") != "", F.expr("substring(_key, 2)").cast(stream.schema[key].dataType)).alias(key)


class Decisions(StatefulProcessor):
    """Steps a rule through the rows of a key: as they come, or in the order of their times once the watermark has passed them."""

    def __init__(self, rule: Rule, tie: str, output: str, in_order: bool):
        self.rule, self.columns, self.in_order = rule, ["_key", "us", tie, output], in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state array<double>")
        self.waiting = handle.getListState("waiting", "us long, tie long, value double")

    def decided(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        known = self.state.get()
        step = self.rule(list(known[0]) if known else None)
        out = [(key[0], us, tie, step(us / 1e6, value)) for us, tie, value in sorted(rows)]
        if out:
            self.state.update(([float(x) for x in step.state],))
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(tie), float(value)) for part in rows for us, tie, value in zip(part["us"], part["tie"], part["value"])]
        if not self.in_order:
            yield self.decided(key, new)
        elif new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()]
        left = [r for r in held if r[0] >= passed]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(left)[0] // 1000 + 1)
        else:
            self.waiting.clear()
        yield self.decided(key, [r for r in held if r[0] < passed])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, key: str, time: str, tie: str, value: str, rule: Rule, output: str, late: str | None = None) -> DataFrame:
    """key, time, tie and the outcome of ``rule`` for each row of a stream, as ``folds.fold`` gives it for a table.

    With ``late`` rows are taken in the order of time and tie: a row waits in its key's state until the watermark, ``late`` behind the newest
    row, has passed it, and a timer calls it; what comes later still is dropped. Without it each trigger's rows are decided at once, in their order,
    as a limiter in front of a service has to.

    ``tie`` is a whole number; rows with a null key are one key, rows without time are dropped with ``late`` and come first without; a null value is NaN.
    """
    marked = stream.withWatermark(time, late) if late else stream
    event_time = [time] if late else []
    rows = marked.select(_filed(key), *event_time, F.coalesce(F.unix_micros(time), F.lit(0)).alias("us"), F.col(tie).cast("long").alias("tie"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"))
    schema = f"_key string, us long, `{tie}` long, `{output}` boolean"
    out = rows.groupBy("_key").transformWithStateInPandas(Decisions(rule, tie, output, bool(late)), schema, "append", "EventTime" if late else "None")
    return out.select(_key_of(stream, key), F.timestamp_micros("us").alias(time), tie, output)


class Results(StatefulProcessor):
    """The last result of a key, until its time to live has passed."""

    def __init__(self, request: str, result: str, ttl_ms: int):
        self.columns, self.ttl_ms = ["_key", request, result, "error"], ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "result string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(at), None if pd.isna(result) else result) for part in rows for at, result in zip(part["at"], part["result"]))
        out = []
        for at, result in new:
            if result is not None:
                self.held.update((result,))
            else:
                known = self.held.get() if self.held.exists() else None
                out.append((key[0], at, known[0] if known else None, None if known else "no result"))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def results_alive(stream: DataFrame, key: str, request: str, result: str, ttl_seconds: float) -> DataFrame:
    """The answers to a stream of requests: rows with a ``result`` are kept for their key, rows without one ask for it.

    key, request, result and error of each asking row: the key's last result, if it came at most ``ttl_seconds`` before by the clock of the stream, else
    ``no result``. Within a trigger rows count in the order of ``request``, a whole number. The state store drops what has outlived its time by itself.
    Times are those of the clock, so such a stream runs on: stop it when it has caught up, it never ends of its own.
    """
    rows = stream.select(_filed(key), F.col(request).cast("long").alias("at"), F.col(result).cast("string").alias("result"))
    schema = f"_key string, `{request}` long, `{result}` string, error string"
    out = rows.groupBy("_key").transformWithStateInPandas(Results(request, result, int(ttl_seconds * 1000)), schema, "append", "ProcessingTime")
    return out.select(_key_of(stream, key), request, result, "error")
