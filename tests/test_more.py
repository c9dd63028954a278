import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from docmill.functions import terms
from docmill.operators import dedup, folds, monitoring
from docmill.plans import documents, more

LONG = "A sentence that is certainly long enough to count as a document, {}."


def test_semantic_duplicates(spark):
    schema = "doc_id long, text string, embedding array<float>"
    known = spark.createDataFrame([(1, LONG.format("one"), [1.0, 0.0]), (2, LONG.format("two"), [0.0, 1.0])], schema)
    asked = [(1, "anything", [0.5, 0.5]), (10, LONG.format("ONE"), [0.0, 1.0]), (11, LONG.format("x"), [0.1, 1.0]), (12, "short", [1.0, 0.0]), (13, LONG.format("y"), [1.0, 1.0]), (14, LONG.format("z"), None)]
    found = {tuple(r) for r in dedup.semantic_duplicates(spark.createDataFrame(asked, schema), known, 0.9).collect()}
    assert found == {(1, 1, "id"), (10, 1, "hash"), (11, 2, "vector")}


def test_tfidf(spark):
    df = spark.createDataFrame([(0, "cat cat dog"), (1, "dog bird"), (2, None)], "id long, text string")
    got = {(r.id, r.term): r.weight for r in terms.tfidf(df, "id", "text").collect()}
    cat, dog = 2 * math.log(4 / 2), math.log(4 / 3)
    assert got[0, "cat"] == pytest.approx(cat / math.hypot(cat, dog)) and set(got) == {(0, "cat"), (0, "dog"), (1, "dog"), (1, "bird")}
    assert {t for _, t in {(r.id, r.term) for r in terms.tfidf(df, "id", "text", 1).collect()}} == {"cat"}
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r.j for r in sets.select(terms.jaccard(F.col("x"), F.col("y")).alias("j")).collect()] == [pytest.approx(1 / 3), 0.0]



def test_limits_one_after_another(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(i, "all", f"u{i % 2}", at(i)) for i in range(8)], "id long, d string, u string, ts timestamp")
    out = folds.all_admit(df, [("d", folds.least_gap(2)), ("u", folds.least_gap(4))], "ts", "id", "ok")
    assert {r.id: r.ok for r in out.collect()} == {i: i in (0, 4) for i in range(8)}


def test_states_storage_and_results(spark):
    rows = spark.createDataFrame([("t", i, s) for i, s in enumerate(("pending", "running", "retrying", "success", "running"))], "k string, i long, s string")
    assert [r.allowed for r in monitoring.transitions(rows, "k", "s", ["i"]).orderBy("i").collect()] == [True, True, True, False, False]
    files = spark.createDataFrame([("a", 1 << 20), ("a", 1 << 19), ("b", 10)], "folder string, n long")
    assert {r.folder: (r.files, r.mb) for r in monitoring.storage(files, "folder", F.col("n")).collect()} == {"a": (2, 1.5), "b": (1, 0.0), None: (3, 1.5)}
    got = monitoring.results_of(rows.select(F.col("i").alias("id")), spark.createDataFrame([(1, "x")], "id long, v string"), "id", "v").collect()
    assert {r.id: r.error for r in got} == {0: "no result", 1: None, 2: "no result", 3: "no result", 4: "no result"}
    assert monitoring.alive(spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 2),)], "ts timestamp"), "ts", "2024-01-02 00:30:00", 3600).count() == 1


def test_queries_take_all_rows(spark, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    line = " ".join(f"word{i:02}" for i in range(20))
    same = "A single line that is its own title and quite long enough."
    write([(1, line, "en", "s"), (2, "  outer blanks ", "en", "s"), (3, None, "en", "s"), (4, same, "en", "s")], "doc_id long, text string, lang string, source string", "documents")
    write([(1, "x" * 1023), (2, "x" * 1024), (3, "x" * (3 << 19)), (4, None)], "page_id long, html string", "pages")
    assert {r.page_id: r.size for r in documents.page_sizes(spark, tmp_path).collect()} == {1: "1023.0 B", 2: "1.0 KB", 3: "1.5 MB", 4: None}
    assert {r.doc_id: (r.description, r.is_short) for r in documents.descriptions(spark, tmp_path).collect()} == {1: (line, True), 2: ("  outer blanks ", True), 3: (None, None), 4: (same, True)}
    assert {r.doc_id: r.tags for r in documents.standard_fields(spark, tmp_path).collect()}[1] == line.replace(" ", ",")
    assert (4, "[WARNING] title: title like content") in {tuple(r) for r in documents.validation_findings_of_all_rules(spark, tmp_path).collect()}


def test_semantic_duplicates_of_other_rows(spark):
    rows = spark.createDataFrame([(1, LONG.format("x"), [1.0, 0.0]), (2, LONG.format("X"), [0.0, 1.0]), (3, LONG.format("y"), [0.1, 1.0])], "doc_id long, text string, embedding array<float>")
    assert {tuple(r) for r in dedup.semantic_duplicates(rows, rows, 0.9, others=True).collect()} == {(1, 2, "hash"), (2, 1, "hash"), (3, 2, "vector")}


def test_own_checks_and_collectors(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", None), ("b", 99.0)], "k string, v double")
    v = F.col("v")
    got = {tuple(r) for r in monitoring.check_rows(df, {"high": v > 4, "low": v < 0}, {"high": v > 90}, ("k",)).collect()}
    assert got == {("a", "high", "warning", 1), ("a", "low", "healthy", 0), ("b", "high", "unhealthy", 1), ("b", "low", "healthy", 0)}
    assert [tuple(r) for r in monitoring.check_rows(df.limit(0), {"high": v > 4}).collect()] == [("high", "healthy", 0)]
    assert [r.custom_metrics for r in monitoring.with_custom_metrics(df, twice=v * 2, one=F.lit(1)).collect()] == [{"twice": 10.0, "one": 1.0}, {"one": 1.0}, {"twice": 198.0, "one": 1.0}]
