"""Roll-ups by increments, signatures of files, changes of one key, versions that a broken job has left."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from docmill.operators import reports, rollups, text_index
from docmill.sources import sinks


def test_a_day_of_hours_equals_one_pass(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second), rng.uniform(0, 9) if rng.random() > 0.1 else None, rng.randint(1, 80)) for second in rng.sample(range(86_400), 1500)]
    events = spark.createDataFrame(rows, "kind string, ts timestamp, value double, user_id long").cache()
    states = lambda df: rollups.hourly_states(df, "ts", ["kind"], "value", "user_id", "value > 8")
    stored = states(events.limit(0))
    for k in range(3):  # rows come mixed, so hours are merged again and again
        part = events.where(F.pmod(F.hash("ts", "user_id"), F.lit(3)) == k)
        stored = spark.createDataFrame(rollups.with_new_hours(stored, states(part), ["kind"]).collect(), stored.schema)
    assert stored.groupBy("kind", "hour").count().where("count > 1").isEmpty()
    for r in rollups.report(stored, "kind").collect():
        own = sorted((t, v, u) for k, t, v, u in rows if k == r.kind)
        values = [v for _, v, _ in own if v is not None]
        assert (r.n, r.failures, r.least, r.most, r.users) == (len(own), sum(v > 8 for v in values), min(values), max(values), len({u for *_, u in own}))
        assert abs(r.total - sum(values)) < 1e-6 and abs(r.mean - statistics.mean(values)) < 1e-9 and r.latest == own[-1][1]
        assert abs(sum(v <= r.median for v in values) / len(values) - 0.5) < 0.05


def test_signatures_leave_out_files_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "docs")
    texts = {"a": ["the quick Brown fox", None, ""], "b": ["lazy dogs", "xx"], "c": ["naïve ÉTÉ 😀 smile"], "d": ["the quick red hen"]}
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    spark.createDataFrame(rows, "doc_id long, folder string, text string").repartition(1).write.partitionBy("folder").parquet(path)
    table = spark.read.parquet(path)
    index = text_index.index_of(table, "text")
    assert index.select("file").distinct().count() == 4
    for query, most in (("QUICK", 2), ("quick brown", 1), ("été 😀", 1), ("lazy dogs", 1), ("not there at all", 0), ("x", 4), ("", 4), ("hen", 1)):
        files = text_index.candidate_files(index, query).count()
        assert files <= most, query
        found = text_index.indexed_search(spark, path, index, query, "text")
        assert sorted(tuple(r) for r in found.select("doc_id", "folder").collect()) == sorted(tuple(r) for r in reports.search(table, query, "text").select("doc_id", "folder").collect())
    read = text_index.indexed_search(spark, path, index, "quick brown", "text")
    assert len(read.inputFiles()) == 1 and len(table.inputFiles()) == 4


def test_of_several_changes_the_last_counts(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, name string, at int")
    changes = spark.createDataFrame([(1, "old", 5), (1, "new", 9), (3, "one", 2), (3, "two", 1), (2, None, 7)], "id long, name string, at int")
    want = {(1, "new", 9), (2, "b", 7), (3, "one", 2)}
    for df in (changes, changes.orderBy(F.desc("at")), changes.union(changes)):
        assert {tuple(r) for r in sinks.upsert(table, df, "id", order="at").collect()} == want and sinks.upsert(table, df, "id", order="at").count() == 3
        assert {tuple(r) for r in reports.updated(table, df, "id", order="at").collect()} == {r for r in want if r[0] < 3}
    assert sinks.upsert(table, changes, "id").count() == 3


def test_what_a_broken_job_left_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.load_state(spark, path, "id long").count() == 0
    sinks.save_state(spark.range(3), path, 1)
    broken = tmp_path / "state" / "version=2" / "_temporary"
    broken.mkdir(parents=True)
    (tmp_path / "state" / "version=2" / "part-0.json").write_text('{"id": 99}\n')
    assert {r.id for r in sinks.load_state(spark, path, "id long").collect()} == {0, 1, 2}
    sinks.save_state(spark.range(7, 9), path, 2)
    assert {r.id for r in sinks.load_state(spark, path, "id long").collect()} == {7, 8}
    sinks.save_state(spark.range(1), path, 2)
    assert sinks.load_state(spark, path, "id long").count() == 2


def test_users_of_hours_are_counted_exactly(spark):
    """9000 users a kind, seen again in several hours and batches; a sketch of them is off by some."""
    n = 9000
    events = spark.range(4 * n).select(
        F.when(F.col("id") % 2 == 0, "a").alias("kind"), F.timestamp_add("MINUTE", (F.col("id") % 600).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"),
        F.lit(1.0).alias("value"), (F.col("id") % (2 * n)).alias("user_id"),
    )
    half = [events.where(f"user_id % 3 {op} 0") for op in ("=", "<>")]
    states = rollups.with_new_hours(*(rollups.hourly_states(h, "ts", ["kind"], "value", "user_id") for h in half), ["kind"])
    users = rollups.with_new_users(*(rollups.hourly_users(h, "ts", ["kind"], "user_id") for h in half))
    assert {r.kind: (r.n, r.users) for r in rollups.report(states, "kind", users=users).collect()} == {"a": (2 * n, n), None: (2 * n, n)}
    assert rollups.report(states, users=users).first().users == 2 * n and rollups.report(states, "kind", users=users.limit(0)).first().users == 0
