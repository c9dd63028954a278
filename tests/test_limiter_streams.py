"""Limiters on streams equal the batch fold, whatever the order and wherever the stream is stopped; results vanish after their time."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmill.operators import folds
from docmill.streaming import limiters, streams

SCHEMA = "event_id long, user string, ts timestamp, value double"
START = pd.Timestamp("2024-01-01")
RULES = {
    "fixed": folds.fixed_window(0.1, 60.0), "sliding": folds.sliding_window(0.1, 60.0), "token": folds.token_bucket(0.05, 3), "leaky": folds.leaky_bucket(0.05, 3),
    "gap": folds.least_gap(25.0), "cooldown": folds.cooldown(50.0, 60.0),
}


@pytest.fixture(autouse=True)
def rocksdb(spark):
    limiters.use_rocksdb(spark)


def events(n: int = 160) -> pd.DataFrame:
    rng = random.Random(9)
    at = sorted(rng.randint(0, 1500) for _ in range(n))
    return pd.DataFrame({"event_id": range(n), "user": [rng.choice(["a", "a", "b", None]) for _ in range(n)], "ts": [START + pd.Timedelta(seconds=s) for s in at], "value": [rng.uniform(0, 100) for _ in range(n)]})


def rows_of(df) -> list[tuple]:
    return sorted((r.event_id, r.ok) for r in df.collect())


@pytest.mark.parametrize("name", RULES)
def test_a_rule_goes_on_from_its_state(name):
    data = events()
    at = [t.timestamp() for t in data["ts"]]
    whole, part = RULES[name](), RULES[name]()
    want, got = [whole(*x) for x in zip(at, data["value"])], []
    for n, x in enumerate(zip(at, data["value"])):
        part = RULES[name](list(part.state)) if n % 7 == 3 else part
        got.append(part(*x))
    assert got == want and 0 < sum(want) < len(want)


@pytest.mark.parametrize("name", ["sliding", "token"])
def test_a_stopped_and_restarted_stream_equals_the_batch_fold(spark, tmp_path, name):
    """Files come in order, two before the stop and two after it; each trigger's rows are decided at once."""
    data, source = events(), tmp_path / "source"
    source.mkdir()
    stream = lambda: limiters.limited(streams.read_stream(spark, str(source), SCHEMA, files=1), "user", "ts", "event_id", "value", RULES[name], "ok")
    for half in (0, 1):
        for k in (2 * half, 2 * half + 1):
            data.iloc[40 * k : 40 * k + 40].to_parquet(source / f"{k}.parquet", coerce_timestamps="us")
            time.sleep(0.02)  # files are taken in the order of their times
        query = streams.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    whole = folds.fold(spark.createDataFrame(data, SCHEMA), "user", "ts", "event_id", "value", RULES[name], "ok")
    got, want = rows_of(spark.read.parquet(str(tmp_path / "out"))), rows_of(whole)
    assert got == want and 0 < sum(ok for _, ok in want) < len(want)


def test_rows_out_of_order_wait_for_the_watermark(spark, tmp_path):
    """Shuffled over files, with a stop in the middle; a last row far ahead moves the watermark past all others."""
    data, source = events(), tmp_path / "source"
    source.mkdir()
    mixed = data.sample(frac=1, random_state=4)
    ahead = pd.DataFrame({"event_id": [999], "user": ["z"], "ts": [START + pd.Timedelta(days=9)], "value": [0.0]})
    stream = lambda: limiters.limited(streams.read_stream(spark, str(source), SCHEMA, files=1), "user", "ts", "event_id", "value", RULES["sliding"], "ok", late="1 hour")
    for parts in (mixed.iloc[:50], mixed.iloc[50:90]), (mixed.iloc[90:], ahead):
        for part in parts:
            part.to_parquet(source / f"{time.time_ns()}.parquet", coerce_timestamps="us")
            time.sleep(0.02)
        streams.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    want = rows_of(folds.fold(spark.createDataFrame(data, SCHEMA), "user", "ts", "event_id", "value", RULES["sliding"], "ok"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want


def test_results_vanish_after_their_time(spark, tmp_path):
    source, out = tmp_path / "source", str(tmp_path / "out")
    source.mkdir()
    schema = "task string, at long, result string"
    stream = limiters.results_alive(streams.read_stream(spark, str(source), schema, "json", files=1), "task", "at", "result", 15.0)

    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="100 milliseconds").format("parquet").start(out)

    def trigger(name: str, rows: list[tuple]) -> None:
        pd.DataFrame(rows, columns=["task", "at", "result"]).to_json(source / f"{name}.json", orient="records", lines=True)
        asked, until = sum(r[2] is None for r in rows) + trigger.asked, time.time() + 90
        while spark.read.schema("task string, at long, result string, error string").parquet(out).count() < asked and time.time() < until:
            time.sleep(0.3)
        trigger.asked = asked

    trigger.asked = 0
    trigger("one", [("a", 1, "done"), ("b", 1, "other"), ("b", 2, "newer"), ("b", 3, None), ("c", 1, None)])
    answers = lambda: {(r.task, r.at): (r.result, r.error) for r in spark.read.parquet(out).collect()}
    assert answers() == {("b", 3): ("newer", None), ("c", 1): (None, "no result")}
    time.sleep(17)
    trigger("two", [("a", 9, None), ("c", 10, "late"), ("c", 11, None)])
    later = answers()
    assert later["a", 9] == (None, "no result") and later["c", 11] == ("late", None)
    assert spark.read.parquet(out).where(F.col("task") == "b").count() == 1
    query.stop()
