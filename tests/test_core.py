"""Near-duplicate flags, feeds, normaliser steps, selectors, schema checks, signatures, jobs."""

import html
import random
import re
import unicodedata
from difflib import SequenceMatcher
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from docmill.functions import feeds, hashing, text
from docmill.functions.html import Selectors, extract, selectors_of
from docmill.operators import dedup, folds, monitoring, reports, validate
from docmill.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"a {kind}").select(column).first()[0]


def score(a, b):
    """The weighted score, step by step."""
    a, b = (re.sub(r"\s+", " ", x.lower()).strip() for x in (a, b))
    digits = [sha256(x.encode()).hexdigest() for x in (a, b)]
    hashes = 1 - sum(x != y for x, y in zip(*digits)) / 256
    share = lambda x, y: min(x, y) / max(x, y)
    kinds = [md5(("S" if len(x) <= 20 else "M" if len(x) <= 100 else "L").encode()).hexdigest() for x in (a, b)]
    return 0.4 * hashes + 0.2 * share(len(a), len(b)) + 0.2 * share(len(a.split()), len(b.split())) + 0.2 * SequenceMatcher(None, *kinds).ratio()


@pytest.mark.parametrize("least", ["normal", 0.8])
def test_similar_flags_equal_brute_force(spark, least):
    rng = random.Random(3)
    data = [(i, " ".join("x" * rng.randint(1, 9) for _ in range(rng.choice((8, 9, 12, 15, 20, 30, 60, 200, 900))))) for i in range(150)]
    data += [(200, data[3][1].upper()), (201, None), (202, "short"), (203, "word " * 3000), (204, data[9][1] + " more")]
    rng.shuffle(data)
    bound = dedup.threshold(least)
    long = sorted((i, t) for i, t in data if t and len(t.strip()) >= 50)
    want = {i for n, (i, t) in enumerate(long) if any(round(score(t, u), 9) >= bound for _, u in long[:n])}
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id for r in dedup.similar_flags(df, least=least).collect() if r.is_similar} == want and 0 < len(want) < len(long)
    assert dedup.similar_flags(df.limit(0)).count() == 0
    flags = {r.doc_id: r.method for r in dedup.is_duplicate(df).collect()}
    assert flags[200] == "content" and flags[201] is None and len(flags) == len(data)
    with pytest.raises(ValueError):
        dedup.threshold(0.5)


def test_a_changed_word_is_a_duplicate_and_so_is_a_title(spark):
    base = "This is the content of a test article that is long enough to be compared with others."
    data = [(1, base, "One"), (2, base.replace("test", "fine"), "Two"), (3, "Quite another text " * 30, "One"), (4, "y " * 400, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, title string")
    assert {r.doc_id: r.method for r in dedup.is_duplicate(df, title_col="title").collect()} == {1: None, 2: "similar", 3: "title", 4: None}


def test_keep_first(spark):
    long = "a text of more than fifty characters, so that it is compared at all"
    df = spark.createDataFrame([(1, long), (2, long.upper()), (3, "short"), (4, "short"), (None, long), (5, None), (1, "another " * 20)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:5]) for r in dedup.keep_first(df).where("text IS NOT NULL").collect()) == [(1, "a tex"), (1, "anoth"), (3, "short"), (4, "short")]
    assert dedup.keep_first(df).where("doc_id = 5").count() == 1


def test_signatures(spark, tmp_path):
    df = spark.createDataFrame([(1, "Some  Text", "T"), (2, None, None)], "doc_id long, text string, title string")
    known = dedup.signatures(df, title_col="title")
    assert [(r.content_length, r.word_count, r.title_hash is None) for r in known.orderBy("doc_id").collect()] == [(9, 2, False), (0, 0, True)]
    dedup.save_signatures(dedup.add_signatures(known, df.where("doc_id = 1").withColumn("text", F.lit("new"))), str(tmp_path / "s"))
    back = dedup.load_signatures(spark, str(tmp_path / "s"))
    assert {r.doc_id: r.content_length for r in back.collect()} == {"1": 3, "2": 0}
    assert [r.doc_id for r in dedup.remove_signatures(back, df.where("doc_id = 1")).collect()] == ["2"]
    mark = spark.createDataFrame([("A  b\n c", "T")], "a string, t string").select(hashing.fingerprint("a", "t").alias("f")).first().f
    assert (mark.first_line, mark.structure, mark.word_count) == ("a b c", "S", 3)


def slow_normalize(t):
    """The chain in plain Python."""
    for a, b in text.MOJIBAKE:
        t = t.replace(a, b)
    t = re.sub(r"&[a-zA-Z]+;|&#[0-9]+;", lambda m: html.unescape(m.group()), unicodedata.normalize("NFKC", t))
    t = re.sub(r"([.!?])\1+", r"\1", re.sub("[-–—]", "-", t))
    t = "\n".join(re.sub(r"^[ \t]+|[ \t]+$", "", x) for x in t.split("\n"))
    t = re.sub(r"\n\s*\n", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()
    t = re.sub(f"([{text.CJK_PUNCTUATION}])\\s+([a-zA-Z0-9])", r"\1\2", t)
    t = re.sub(f"([a-zA-Z0-9])\\s+([{text.CJK_PUNCTUATION}])", r"\1\2", t)
    parts = [re.sub(" +", " ", re.sub(r"\n+", " ", p)).strip() for p in t.split("\n\n")]
    return "\n\n".join(p for p in parts if p)


def test_normalize_equals_brute_force_on_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = ['he said "hello world" and \'then\' left', "a\tb  c \n\n \n d--e... 中文， abc 。x ！", "Ã©tÃ© &amp; ｆｕｌｌ &#65; €", "", "line one\nline two\n\n\n\nthree"]
    rows = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in rows.select("text", text.normalize("text").alias("n")).collect():
        assert r.n == slow_normalize(r.text), r.text[:200]
    assert one(spark, text.normalize("a"), odd[0]) == odd[0]


def test_steps_of_the_chain_can_be_left_out(spark):
    steps = lambda **k: one(spark, text.normalize("a", use=text.Normalization(**k)), "a – b...\n\n\nc  ， d &amp;")
    assert "–" in steps(dashes=False) and "..." in steps(punctuation=False) and "&amp;" in steps(html_entities=False)
    assert "\n\n\n" in steps(empty_lines=False, paragraphs=False) and "  " in steps(extra_whitespace=False, paragraphs=False)
    words = " ".join(str(i) for i in range(2000))
    import textwrap

    assert one(spark, text.wrap("a", 30), words) == "\n".join(textwrap.wrap(words, 30))
    assert one(spark, text.wrap("a", 3), " abcdef g h i ") == "abcdef\ng h\ni" and one(spark, text.wrap("a", 3), " ") == ""
    assert [one(spark, text.human_timestamp("a"), x) for x in ("2024-01-20T10:00:00Z", "later", None, "")] == ["2024-01-20 10:00:00", "later", "N/A", "N/A"]


RSS = """<rss><channel><title>f</title><item><title> First </title><link>http://a/1</link><description>&lt;p&gt;Hello  you&lt;/p&gt;</description><pubDate>Sat, 20 Jan 2024 10:00:00 +0000</pubDate><category>x</category></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><id>urn:1</id><title type="html">Second</title><link rel="alternate" href="http://a/2"/><link rel="enclosure" href="http://a/m.mp3"/>
<summary>plain</summary><updated>2024-01-21T10:00:00Z</updated><author><name>Ann</name></author><category term="y"/><category term="z"/></entry><entry><title>Third</title><link href="http://a/3"/></entry></feed>"""


def test_feeds_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    (tmp_path / "c.xml").write_text("no feed")
    out = {r.title: r for r in readers.reader_of("atom")(spark, str(tmp_path)).collect()}
    assert set(out) == {"First", "Second", "Third"}
    assert (out["First"].content, out["First"].is_html, out["First"].published, out["First"].tags) == ("Hello you", True, "2024-01-20 10:00:00", ["x"])
    assert (out["Second"].id, out["Second"].link, out["Second"].media_url, out["Second"].author, out["Second"].tags) == ("urn:1", "http://a/2", "http://a/m.mp3", "Ann", ["y", "z"])
    assert out["Second"].published == "2024-01-21 10:00:00" and out["Third"].id == "http://a/3" == out["Third"].link and out["Third"].tags == []


def test_standard_items(spark):
    items = spark.createDataFrame([("t", "<b>" + "long  " * 40 + "</b>", "2024"), ("u", "short", None)], "title string, description string, date string")
    out = feeds.standard_item(items, {"name": "n", "type": "rss", "tags": ["a"]}).collect()
    assert len(out) == 1 and out[0].content == ("long " * 40).strip() and out[0].pub_date == "2024" and out[0].source_name == "n" and out[0].tags == ["a"] and out[0].link == ""


def test_own_selectors():
    page = "<html><body><h1>Default title</h1><div class='mine'>My own title</div><p id='who'>By: Ann Example</p><div class='ad'>advert</div><article>" + "word " * 60 + "</article></body></html>"
    own = selectors_of({"title": ".mine", "author": ["#nobody", "#who"], "exclude": ".ad"})
    assert extract(page, None, own)["title"] == "My own title" and extract(page, None, own)["author"] == "Ann Example" and extract(page, None)["title"] == "Default title"
    assert isinstance(own, Selectors) and "script" in own.exclude and extract(page, None)["author"] is None
    assert extract("<body>" + "One sentence here. " * 30 + "</body>", None)["summary"] == "One sentence here。" * 9


def test_schema_check(spark):
    df = spark.createDataFrame([("a", " ", 5), (None, "x", None)], "title string, content string, tags int").withColumn("other", F.lit(1))
    found = [{(f.field, f.rule, f.level) for f in r.schema_findings} for r in validate.schema_findings(df).collect()]
    assert found[0] == {("source", "missing_field", "error"), ("content", "empty_field", "error"), ("tags", "field_type", "error"), ("other", "unknown_field", "warning")}
    assert ("title", "missing_field", "error") in found[1] and ("tags", "field_type", "error") not in found[1]
    rules = validate.Rules([validate.length_rule("tags", 1, 2, kind="array"), validate.match_rule("title", "[a-z]+$")])
    tagged = spark.createDataFrame([(["a", "b", "c"], "Bad"), (["a"], "good")], "tags array<string>, title string").select(rules.findings(["tags", "title"]).alias("f")).collect()
    assert [[x.rule for x in r.f] for r in tagged] == [["tags_length", "title_format"], []]


def test_alert_rules_and_states(spark):
    rules = monitoring.alert_rules(spark, ("high_cpu_usage", "cpu_percent", 50.0, "warning", 1), ("mine", "load", 1.0, "info", 2))
    assert rules.count() == 6 and rules.where("rule = 'high_cpu_usage'").first().bound == 50
    metrics = spark.createDataFrame([("cpu_percent", 60.0), ("cpu_percent", 40.0), ("load", 2.0), ("unknown", 9.0)], "metric string, value double")
    assert {(r.metric, r.rule) for r in monitoring.breaches(metrics, rules).collect()} == {("cpu_percent", "high_cpu_usage"), ("load", "mine")}
    wide = spark.createDataFrame([(60.0, 1.0), (60.0, 9.0)], "cpu double, load double")
    assert monitoring.breaches_of(wide, "cpu > 50 AND load > 5", "both").count() == 1
    assert one(spark, reports.finite_or_zero(F.col("a")), float("inf"), "double") == 0 == one(spark, reports.finite_or_zero(F.col("a")), None, "double")


def test_backup_cleanup_counters_and_migration(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.txt").write_text("one")
    (files / "b.txt").write_text("two")
    none = spark.createDataFrame([], "path string, md5 string")
    first = sinks.back_up(spark, str(files), none, str(tmp_path / "copy"))
    manifest = spark.createDataFrame(first.collect(), "path string, md5 string")
    assert manifest.count() == 2
    (files / "a.txt").write_text("changed")
    assert sinks.changed_files(spark, str(files), manifest).count() == 1
    after = sinks.back_up(spark, str(files), manifest, str(tmp_path / "copy"))
    assert after.count() == 2 and spark.read.parquet(str(tmp_path / "copy")).count() == 3
    listing = readers.file_listing(spark, str(files))
    assert sinks.files_older_than(listing, "2000-01-01", 1).count() == 0 and sinks.files_older_than(listing, "2100-01-01", 1).count() == 2
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, v string")
    assert tuple(sinks.affected(old, new, "id").first()) == (1, 1, 1)
    raw = spark.createDataFrame([("not-a-uuid", "7", '["a"]'), ("0F8FAD5B-D9CB-469F-A165-70867728950E", "x", '{"a": 1}')], "id string, n string, tags string")
    out = sinks.migrated(raw, "id string, n int, tags array<string>, more string", ("n",), ("id",), ("tags",)).collect()
    assert [(r.n, r.tags, r.more, r.valid) for r in out] == [(7, ["a"], None, True), (None, None, None, False)]
    assert re.match(sinks.UUID, out[0].id) and out[1].id == "0f8fad5b-d9cb-469f-a165-70867728950e"


def test_logs_cache_and_item_files(spark, tmp_path):
    (tmp_path / "x.log").write_text("2024-01-20 10:00:00 [ERROR] bad thing\n2024-01-20 11:00:00 - INFO - no ERROR here\nplain\n")
    lines = readers.log_lines(spark, str(tmp_path / "x.log"), "error").collect()
    assert [(r.time, r.level, r.message) for r in lines] == [("2024-01-20 10:00:00", "ERROR", "bad thing")]
    cache = spark.createDataFrame([], "key string, response string, expires_at timestamp")
    asked = spark.createDataFrame([("u", "GET", "r")], "url string, method string, response string")
    cache = readers.with_responses(cache, asked, "2024-01-01 00:00:00", 60)
    assert readers.cached(asked.drop("response"), cache, "2024-01-01 00:00:30").first().hit and not readers.cached(asked.drop("response"), cache, "2024-01-01 00:02:00").first().hit
    (tmp_path / "r.json").write_text('{"source_name": "s", "url": "u", "collected_at": "2024", "items": [{"a": 1}, {"a": 2}]}')
    assert [(r.source_name, r["items"]) for r in readers.item_files(spark, str(tmp_path)).collect()] == [("s", 2)]
    tables = {"t": asked}
    assert reports.catalog_of(spark, tables).count() == 3 and reports.enabled(spark.createDataFrame([(None,), (False,), (True,)], "enabled boolean")).count() == 2


def test_documents_are_standardised_in_depth(spark):
    row = spark.createDataFrame([("a  – b &amp; c", [" x\ty ", None, "ｆ"], ("ü  &lt;", 3), 5)], "a string, l array<string>, s struct<t: string, n: int>, n int")
    out = text.standardized(row, skip=("n",)).first()
    assert (out.a, out.l, out.s.t, out.s.n, out.n) == ("a - b & c", ["x y", None, "f"], "ü <", 3, 5)
    docs = spark.createDataFrame([("[News] A title", ["B b", "a!", "B b"], "2024/01/20", "By: Ann", "Content here.", ""), (None, None, None, None, None, "kept")], "title string, tags array<string>, publish_date string, author string, content string, summary string")
    assert [tuple(r) for r in text.special_fields(docs).collect()] == [("A title", ["b-b"], "2024-01-20", "Ann", "Content here.", "Content here."), (None, None, None, None, None, "kept")]


def test_state_lists_and_similar_documents(spark, tmp_path):
    for version, value in ((1, "old"), (2, "new"), (2, "again")):
        sinks.save_state(spark.createDataFrame([("a", value)], "k string, v string"), str(tmp_path / "state"), version)
    assert [tuple(r) for r in sinks.load_state(spark, str(tmp_path / "state"), "k STRING, v STRING").collect()] == [("a", "new")]
    assert [one(spark, sinks.decoded_list("a"), x) for x in ('["x", "y"]', '{"x": 1}', "[broken", None)][:2] == [["x", "y"], None]
    docs = spark.createDataFrame([(1, "one", [1.0, 0.0]), (2, "two", [0.9, 0.1]), (3, "three", [0.0, 1.0]), (4, "none", None)], "doc_id long, text string, embedding array<float>")
    out = dedup.similar_documents(docs, docs.where("doc_id = 1"))
    assert [(r.query_id, r.doc_id, r.rank, r.text) for r in out.collect()] == [(1, 2, 1, "two")]
    times = spark.createDataFrame([(1, "same text", "2024"), (2, "Same  text", "2025")], "doc_id long, text string, at string")
    assert [(r.min_published_at, r.max_published_at) for r in dedup.duplicate_groups(times, published_col="at").collect()] == [("2024", "2025")]
