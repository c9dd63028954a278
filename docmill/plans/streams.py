"""Queries that run as streams over the tables and give the rows of their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docmill.operators import folds
from docmill.plans.base import ORACLE, QUERIES, table
from docmill.streaming import limiters, streams
from docmill.tables import tables_dir


def _streamed(rule: folds.Rule):
    """The events as a file stream in the order of their times; a last row without a user, two days ahead, moves the watermark past all others."""

    def run(spark, sf_dir):
        base = f"{tables_dir(spark)}/stream-{uuid.uuid4().hex}"
        events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
        schema = "event_id long, user_id long, ts timestamp, value double"
        events.write.parquet(f"{base}/source")
        last = events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(0.0).alias("value"))
        last.write.mode("append").parquet(f"{base}/source")
        limiters.use_rocksdb(spark)
        source = streams.read_stream(spark, f"{base}/source", schema, files=100_000)
        decided = limiters.limited(source, "user_id", "ts", "event_id", "value", rule, "admitted", late="1 day")
        streams.run_once(decided, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return spark.read.schema("user_id long, ts timestamp, event_id long, admitted boolean").parquet(f"{base}/out").select("event_id", "admitted")

    return run


QUERIES["streamed_sliding_window"] = _streamed(folds.sliding_window(3.0 / 86_400, 86_400))
ORACLE["streamed_sliding_window"] = ORACLE["sliding_window_limiter"]
QUERIES["streamed_token_bucket"] = _streamed(folds.token_bucket(1 / 18_000, 2))
ORACLE["streamed_token_bucket"] = ORACLE["token_bucket"]
