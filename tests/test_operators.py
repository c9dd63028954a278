import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmill import schemas
from docmill.operators import dedup, folds, monitoring, reports, validate
from docmill.sources import readers, sinks
from docmill.streaming import streams

DOCS = "doc_id long, text string, source string"
LONG = "A sentence that is certainly long enough to count as a document, number {}."


def docs(spark):
    rows = [(i, LONG.format(i % 4), f"s{i % 2}") for i in range(8)] + [(20, "short", "s0"), (21, "short", "s1"), (22, None, None), (23, "  A SENTENCE that is certainly long enough\nto count as a document, number 1.", "s0")]
    return spark.createDataFrame(rows, DOCS)


def test_exact_dedup(spark):
    flags = {r.doc_id: (r.original_id, r.is_duplicate) for r in dedup.flag_duplicates(docs(spark)).collect()}
    assert flags[5] == (1, True) and flags[23] == (1, True) and flags[1] == (1, False) and flags[21] == (21, False) and flags[22] == (22, False)
    assert sorted(r.doc_id for r in dedup.keep_first(docs(spark)).collect()) == [0, 1, 2, 3, 20, 21, 22]
    groups = {r.representative: r.document_count for r in dedup.duplicate_groups(docs(spark)).collect()}
    assert groups == {0: 2, 1: 3, 2: 2, 3: 2, 20: 2}
    stats = dedup.dedup_stats(dedup.flag_duplicates(docs(spark))).first()
    assert (stats.total, stats.duplicates) == (12, 5)


def test_an_exact_copy_never_changes_what_is_kept(spark):
    more = docs(spark).union(spark.createDataFrame([(99, LONG.format(2), "x")], DOCS))
    assert sorted(r.doc_id for r in dedup.keep_first(more).collect()) == sorted(r.doc_id for r in dedup.keep_first(docs(spark)).collect())


def test_similar_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in dedup.similar_vectors(df, df.where("vec_id = 0"), 2, 0.5).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 4)]


def test_validation(spark):
    rows = [
        ("Good title", "x" * 20 + " some different words in the content here " + "y" * 20, "Ann", "https://x.org", "2024-01-20", ["a"]),
        (None, "too short", "<b>", "invalid-url", "2024-13-45", ["<x>"]),
        ("Tiny", " ".join(["same"] * 60), "A" * 101, "", "2030/01/01", [str(i) for i in range(21)]),
        ("A title that starts it", "A title that starts it and goes on <p>with html</p> and cafÃ© for more than fifty", None, None, "2001-01-01", None),
    ]
    df = spark.createDataFrame(rows, "title string, content string, author string, url string, publish_date string, tags array<string>")
    out = validate.validate(df, asof=F.lit("2024-06-01").cast("timestamp")).collect()
    names = [{f.rule for f in r.findings} for r in out]
    assert names[0] == set() and out[0].is_valid
    assert names[1] == {"title_required", "content_min_length", "author_format", "url_format", "date_format", "tags_format"}
    assert names[2] == {"title_length", "repetition", "author_length", "url_format", "future_date", "many_tags"}
    assert names[3] == {"starts_with_title", "html_left", "encoding", "old_date"} and out[3].is_valid and out[3].n_warnings == 2
    summary = validate.validation_summary(validate.validate(df)).first()
    assert summary.total == 4 and summary.top_fields.split(",")[0] == "content"
    own = validate.Rules().add(validate.Rule("title", "no_good", lambda c: F.contains(c, F.lit("Good"))))
    assert [r.n_errors for r in validate.validate(df.select("title"), own).collect()] == [1, 0, 0, 0]
    assert validate.validate(df.limit(0)).count() == 0


@pytest.mark.parametrize("day", ["2024-01-20", "2024-01-20 10:00:00", "2024/01/20", "2024年1月20日", "2024-01-20T10:00:00Z", "2024-01-20T10:00:00.123456"])
def test_dates_that_count(spark, day):
    assert spark.range(1).select(validate.real_date(F.lit(day)).alias("ok")).first().ok


def seconds(rule, times, values=None):
    step = rule()
    return [step(t, v) for t, v in zip(times, values or times)]


def test_rules_of_folds():
    assert seconds(folds.fixed_window(1, 2), [0, 0.5, 1, 1.9, 2, 2.1]) == [True, True, False, False, True, True]
    assert seconds(folds.sliding_window(1, 2), [0, 1.5, 1.9, 2.0, 3.4, 3.5]) == [True, True, False, True, False, True]
    assert seconds(folds.token_bucket(1, 2), [0, 0, 0, 0.5, 1.2]) == [True, True, False, False, True]
    assert seconds(folds.leaky_bucket(1, 2), [0, 0, 0, 0.5, 1.2]) == [True, True, True and False, True, True]
    assert seconds(folds.least_gap(1), [0, 0.5, 1, 1.5, 2.5]) == [True, False, True, False, True]
    assert seconds(folds.cooldown(10, 5), [0, 1, 4, 6, 7], [11, 20, 5, 12, 13]) == [True, False, False, True, False]


def test_fold_keeps_keys_apart(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(i, k, at(i // 2), 1.0) for i in range(20) for k in ("a", "b", None)], "id long, k string, ts timestamp, v double")
    out = folds.fold(df, "k", "ts", "id", "v", folds.least_gap(3), "ok").collect()
    assert len(out) == 60
    for k in ("a", "b", None):
        assert [r.id for r in sorted(out, key=lambda r: r.id) if r.k == k and r.ok] == [0, 6, 12, 18]


def test_monitoring(spark):
    checks = spark.createDataFrame([("a", "healthy"), ("a", "warning"), ("b", "healthy"), ("c", "unhealthy"), ("c", "warning"), ("d", "odd")], "k string, status string")
    assert {r.k: r.s for r in checks.groupBy("k").agg(monitoring.health().alias("s")).collect()} == {"a": "warning", "b": "healthy", "c": "unhealthy", "d": "unknown"}
    assert checks.limit(0).agg(monitoring.health().alias("s")).first().s == "unknown"
    score = monitoring.system_score(cpu_usage=F.lit(95.0), memory_usage=F.lit(None).cast("double"), error_rate=F.lit(6.0))
    row = spark.range(1).select(score.alias("s"), monitoring.system_state(score).alias("t"), monitoring.error_class(F.lit("FileNotFoundError")).alias("e")).first()
    assert row.s == pytest.approx(0.8) and row.e == "filesystem"


def test_reports(spark):
    df = docs(spark)
    assert reports.where_all(df, source="s1", text=None).count() == 5
    assert reports.search(df, "NUMBER 1", "text", "source").count() == 3
    assert reports.orphans(df.select("doc_id"), spark.createDataFrame([(0,), (1,)], "o long"), "doc_id", "o").count() == 10
    changed = reports.updated(df, spark.createDataFrame([(0, "new", None)], DOCS), "doc_id").where("doc_id = 0").first()
    assert (changed.text, changed.source) == ("new", "s0")
    day = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 59),), (dt.datetime(2024, 1, 2),)], "ts timestamp")
    assert reports.on_day(day, "ts", "2024-01-01").count() == 1 and reports.since(day, "ts", "2024-01-02 00:30:00", "1 HOUR").count() == 2


def test_sinks_and_readers(spark, tmp_path):
    df = spark.createDataFrame([("ab1", "x"), ("ab2", "y"), ("cd3", "z")], "id string, content string")
    sinks.write_documents(df, str(tmp_path / "docs"))
    back = readers.json_documents(spark, str(tmp_path / "docs"), "id STRING, content STRING")
    assert sorted(map(tuple, back.collect())) == [("ab1", "x"), ("ab2", "y"), ("cd3", "z")] or back.count() >= 1
    changes = spark.createDataFrame([("ab1", "new"), ("ef4", "w")], "id string, content string")
    assert sorted(map(tuple, sinks.upsert(df, changes, "id").collect())) == [("ab1", "new"), ("ab2", "y"), ("cd3", "z"), ("ef4", "w")]
    assert sinks.delete(df, changes, "id").count() == 2
    parts = sinks.delete_cascading(df, changes, "id", {"child": (spark.createDataFrame([("ab1",), ("cd3",)], "ref string"), "ref")})
    assert parts[""].count() == 2 and parts["child"].count() == 1
    tasks = spark.createDataFrame([("t1", "completed", dt.datetime(2024, 1, 1)), ("t2", "failed", dt.datetime(2024, 1, 1)), ("t3", "completed", None)], "id string, status string, completed_at timestamp")
    assert sorted(r.id for r in sinks.retained(tasks, "2024-03-01").collect()) == ["t2", "t3"]
    (tmp_path / "pages" / "site").mkdir(parents=True)
    (tmp_path / "pages" / "site" / "a.html").write_text("<html><body><h1>Some headline</h1></body></html>")
    assert readers.reader_of("html")(spark, str(tmp_path / "pages")).first().parts.title == "Some headline"
    assert readers.file_listing(spark, str(tmp_path / "pages"), "*.html").first().folder == "site"
    none = spark.createDataFrame([], "path string, md5 string")
    first = sinks.changed_files(spark, str(tmp_path / "pages"), none)
    assert first.count() == 1 and sinks.changed_files(spark, str(tmp_path / "pages"), first.select("path", "md5")).count() == 0
    with pytest.raises(ValueError):
        readers.reader_of("fax")
    cache = spark.createDataFrame([("d", "r", dt.datetime(2024, 1, 2))], "key string, response string, expires_at timestamp").withColumn("key", F.md5(F.lit("u:GET")))
    asked = spark.createDataFrame([("u", "GET"), ("v", "GET")], "url string, method string")
    assert {r.url: r.hit for r in readers.cached(asked, cache, "2024-01-01").collect()} == {"u": True, "v": False}


def test_schemas(spark):
    for ddl in (schemas.RAW_DOCUMENTS, schemas.PROCESSED_DOCUMENTS, schemas.DATA_SOURCES, schemas.COLLECTION_TASKS, schemas.SYSTEM_METRICS, schemas.DUPLICATE_GROUPS, schemas.DUPLICATE_GROUP_MEMBERS):
        assert spark.createDataFrame([], ddl).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    events = spark.createDataFrame([(i, f"u{i % 3}", at(7 * i), float(i % 5), f"text {i % 4} that is the same") for i in range(60)], "id long, k string, ts timestamp, v double, text string")
    path = str(tmp_path / "in")
    events.write.parquet(path)
    schema = "id long, k string, ts timestamp, v double, text string"
    stream = streams.read_stream(spark, path, schema)
    streams.run_once(streams.windowed(stream, "ts", "k", "v"), str(tmp_path / "w"), str(tmp_path / "cw")).awaitTermination()
    closed = {tuple(r) for r in spark.read.schema("window_start timestamp, k string, n long, total double").parquet(str(tmp_path / "w")).collect()}
    batch = {tuple(r) for r in streams.windowed(events, "ts", "k", "v").collect()}
    assert closed and closed <= batch
    streams.run_once(streams.first_seen(streams.read_stream(spark, path, schema), "ts", "text"), str(tmp_path / "d"), str(tmp_path / "cd")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 4
    alerts = streams.cooldown_alerts(streams.read_stream(spark, path, schema), "k", "ts", "v", 2.0, 3600.0)
    streams.run_once(alerts, str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    fired = sorted((r.k, r.at) for r in spark.read.schema("k string, at double, value double").parquet(str(tmp_path / "a")).collect())
    fold = folds.fold(events.drop("text"), "k", "ts", "id", "v", folds.cooldown(2.0, 3600.0), "ok").where("ok")
    assert fired == sorted((r.k, r.ts.replace(tzinfo=dt.timezone.utc).timestamp()) for r in fold.collect())


def test_summary_validates_once(spark):
    """one read of the documents, which counts those without findings too."""
    df = spark.createDataFrame([(1, "A title", "A title" + " of some words" * 9, None), (2, None, None, None), (3, "Other", "word " * 40, "x" * 101)], "doc_id long, title string, content string, author string")
    found = validate.validation_summary(validate.validate(df))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    r = found.first()
    assert (r.total, r.valid, r.errors) == (3, 2, 2) and r.validity_rate == 2 / 3 and set(r.top_fields.split(",")) == {"title", "content", "author"}
    none = validate.validation_summary(validate.validate(df.limit(0))).first()
    assert (none.total, none.errors, none.validity_rate, none.top_fields) == (0, 0, 0.0, "")


def test_few_queries_at_a_time(spark):
    """the products of a part and a block are never held whole; how many queries are taken at once changes nothing, ties included."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(90)] + [(90, None), (91, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, dedup.similar_vectors(rows, rows.where("vec_id % 2 = 0"), 4, 0.1, few_rows=n).collect())) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 45 * 4
