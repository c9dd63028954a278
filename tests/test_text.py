import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from docmill.functions import feeds, hashing, html, text, times


def one(spark, column, *values, kind="string"):
    """The column over a table of one row, whose columns are a, b, …"""
    schema = ", ".join(f"{n} {kind}" for n in "abc"[: len(values)])
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""),
        ("", ""),
        ("  Hello   World\t! ", "Hello World !"),
        ("a...b!!!c??? d", "a.b!c? d"),
        ("x – y — z", "x - y - z"),
        ("cafÃ© â€™s", "café 's"),
        ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"),
        ("a &amp; b &#65; &#x41;", "a & b A &#x41;"),
        ("first line\nsecond line\n\n\n\nnext", "first line second line\n\nnext"),
        ("中文。 abc", "中文。abc"),
        ("价格， abc", "价格, abc"),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize("a"), raw) == want


def test_normalize_is_idempotent_on_its_results(spark):
    raw = "  Some “quoted”  text...\n\n\nwith — dashes &quot;and&quot; more!!  "
    once = one(spark, text.normalize("a"), raw)
    assert one(spark, text.normalize("a"), once) == once


def test_wrap(spark):
    assert one(spark, text.normalize("a", 10), "aaa bbb ccc\n\nddddddddddddd e") == "aaa bbb\nccc\nddddddddddddd\ne"


def test_addresses(spark):
    raw = "see https://a.example.com/x?y=1 or www.b.org now, mail me.x@mail.example.com <http://c.net>"
    assert one(spark, text.extract_urls("a"), raw) == ["https://a.example.com/x?y=1", "www.b.org", "http://c.net"]
    assert one(spark, text.extract_emails("a"), raw) == ["me.x@mail.example.com"]
    assert one(spark, text.mask_addresses("a"), raw) == "see [URL] or [URL] now, mail [EMAIL] <[URL]>"


@pytest.mark.parametrize(("raw", "want"), [("中文文本", "chinese"), ("plain words", "english"), ("abcdefg中文", "mixed"), ("  ", "unknown"), ("", "unknown"), (None, "unknown")])
def test_script(spark, raw, want):
    assert one(spark, text.script_of("a"), raw) == want


def test_standard_fields(spark):
    assert one(spark, text.standard_title("a"), "【News】 Site: The title") == "The title"
    assert one(spark, text.standard_date("a"), "on 2024/1/20 at") == "on 2024-1-20 at"
    assert one(spark, text.standard_date("a"), "20-01-2024") == "2024-20-01" and one(spark, text.standard_date("a"), "2024年1月20日") == "2024-1-20" and one(spark, text.standard_date("a"), None) == ""
    assert one(spark, text.standard_author("a"), "By: Ann (Staff)") == "Ann" and one(spark, text.standard_author("a"), "Byron") == "ron"
    assert one(spark, text.standard_tags("a"), ["  Python  ", "TEST", "a b!c", "x", None, "test"], kind="array<string>") == ["a-bc", "python", "test"]
    assert one(spark, text.truncate("a", 5), "abcdefg") == "abcde..."
    assert one(spark, text.domain("a"), "HTTPS://user@Ex.COM:80/x") == "user@ex.com:80" and one(spark, text.domain("a"), "not a url") is None


def test_summary(spark):
    long = "One two three. " * 30
    got = one(spark, text.summary("a"), long)
    assert got.startswith("One two three。One") and len(got) <= 200 + 20
    assert one(spark, text.summary("a"), " short  text ") == "short text" and one(spark, text.summary("a"), None) == ""


def test_hashes_and_similarities(spark):
    assert one(spark, hashing.content_hash("a"), "  A  b\nC ") == one(spark, F.sha2(F.lit("a b c"), 256), "x") and one(spark, hashing.content_hash("a"), None) == ""
    assert one(spark, hashing.hex_similarity("a", "b"), "abcd", "abce") == pytest.approx(1 - 1 / 16)
    assert one(spark, hashing.cosine("a", "b"), [1.0, 0.0], [1.0, 1.0], kind="array<float>") == pytest.approx(2**-0.5)
    assert one(spark, hashing.cosine("a", "b"), [0.0], [1.0], kind="array<float>") == 0 == one(spark, hashing.cosine("a", "b"), [1.0], [1.0, 2.0], kind="array<float>")
    assert one(spark, hashing.ratio(F.col("a"), F.col("b")), 0, 0, kind="int") == 1 and one(spark, hashing.ratio(F.col("a"), F.col("b")), 0, 3, kind="int") == 0


def test_simhash_is_near_for_near_texts(spark):
    base = " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame([(0, base), (1, base.replace("word7 ", "other ")), (2, " ".join(f"else{i}" for i in range(200)))], "id long, text string")
    h = {r.id: r.simhash for r in hashing.simhash(df, "id", "text").collect()}
    far = lambda a, b: bin((h[a] ^ h[b]) & (2**64 - 1)).count("1")
    assert far(0, 1) < 12 < far(0, 2)


def test_cron():
    assert times.parse_cron("*/20 8-10 1,15 * 1-5/2") == times.Cron((0, 20, 40), (8, 9, 10), (1, 15), tuple(range(1, 13)), (1, 3, 5))
    assert times.parse_cron("@weekly").weekday == (0,)
    for bad in ("* * * *", "61 * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            times.parse_cron(bad)


def test_next_runs(spark):
    start = dt.datetime(2024, 2, 28, 23, 59, 30)
    df = spark.createDataFrame([(start,)], "ts timestamp")
    for cron, want in (("0 0 29 2 *", dt.datetime(2024, 2, 29)), ("* * * * *", dt.datetime(2024, 2, 29)), ("30 12 * * 0", dt.datetime(2024, 3, 3, 12, 30)), ("0 0 31 2 *", None)):
        assert times.next_runs(df, "ts", cron).first().next_run == want


def test_lenient_timestamps(spark):
    want = dt.datetime(2024, 1, 20, 8, 0)
    for raw in ("2024-01-20 08:00:00", "2024-01-20T08:00:00Z", "Sat, 20 Jan 2024 08:00:00 +0000"):
        assert one(spark, times.lenient_timestamp("a"), raw) == want
    assert one(spark, times.lenient_timestamp("a"), "soon") is None
    assert one(spark, times.retry_delay("a", 1.0, 30.0), 3, kind="int") == 8.0 and one(spark, times.retry_delay("a", 1.0, 30.0), 9, kind="int") == 30.0


PAGE = """<html lang="en"><head><title>Fallback title</title><meta name="keywords" content="One, two"><meta name="description" content=" About &amp; more ">
<link rel="canonical" href="https://x.org/c"></head><body><header><h1>Site name here</h1></header><nav><a href="/nav">n</a></nav>
<article><h1>The real   headline</h1><p class="author">By Ann Lee<p><time datetime="2024-01-20T10:00">then</time><div class="tags"><a href="/t/1">alpha</a> <a href="#x">beta</a></div>
<p>""" + "Body text goes on. " * 20 + """<img src="/i.png" alt=" pic "><a href="more.html" title="T">read <b>more</b></a><script>var x = 1;</script></article></body></html>"""


def test_html(spark):
    got = one(spark, html.extracted("a", "b"), PAGE, "https://x.org/a/")
    assert got.title == "The real headline" and got.author == "Ann Lee" and got.publish_date == "2024-01-20" and got.summary == "About & more"
    assert got.tags == ["One", "alpha", "beta", "two"] and "var x" not in got.content and "Body text" in got.content and "Site name" not in got.content
    assert [(x.href, x.text, x.title) for x in got.links] == [("https://x.org/t/1", "alpha", None), ("https://x.org/a/more.html", "read more", "T")]
    assert [(i.src, i.alt) for i in got.images] == [("https://x.org/i.png", "pic")]
    assert got.metadata["language"] == "en" and got.metadata["canonical_url"] == "https://x.org/c"
    for broken in (None, "", "<p><b>un<i>closed", "</div></p>", "<" * 50):
        assert one(spark, html.extracted("a", "b"), broken, None).tags == []
    assert one(spark, html.absolute_url("a", "b"), "https://x.org/a/b", "../c") == "https://x.org/c"


def test_feed(spark):
    xml = """<rss><channel><title>F</title><item><title>First item</title><link>https://x.org/1</link><guid>g1</guid><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description>
    <pubDate>Sat, 20 Jan 2024 08:00:00 +0000</pubDate><category>a</category><category>b</category></item><item><title>Bare</title></item></channel></rss>"""
    rows = feeds.entries(spark.createDataFrame([(xml,), ("no xml",)], "xml string"), "xml").collect()
    first = next(r for r in rows if r.id == "g1")
    assert (first.title, first.link, first.content, first.is_html, first.published, first.tags) == ("First item", "https://x.org/1", "Some text", True, "2024-01-20 08:00:00", ["a", "b"])
    assert next(r for r in rows if r.title == "Bare").id == "Bare"


def _plan(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_simhash_moves_documents_and_not_words(spark):
    """one exchange by id, behind the sums; repeated ids count together."""
    from docmill.functions import hashing

    df = spark.createDataFrame([(1, "a b b"), (2, "x"), (2, "Y y"), (3, None), (4, "")], "doc_id long, text string")
    found = hashing.simhash(df, "doc_id", "text")
    assert _plan(found).count("Exchange") == 1
    codes = {w: spark.sql(f"SELECT xxhash64('{w}')").first()[0] for w in "abxy"}
    vote = lambda ws: sum(1 << b for b in range(64) if sum(1 if codes[w] >> b & 1 else -1 for w in ws) > 0)
    assert {r.doc_id: r.simhash % 2**64 for r in found.collect()} == {1: vote("abb"), 2: vote("xyy")}


def test_terms_are_counted_where_their_text_is(spark):
    """texts move once, their words don't; rows of one id count together."""
    from docmill.functions import terms

    df = spark.createDataFrame([(1, "to be or not to be"), (2, "b a"), (2, "a c"), (3, None), (4, "")], "doc_id long, text string")
    counts = terms.term_counts(df, "doc_id", "text", terms.words)
    assert _plan(counts).count("Exchange") == 1
    assert {(r.id, r.term, r.n, r.first) for r in counts.collect()} == {(1, "to", 2, 0), (1, "be", 2, 1), (1, "or", 1, 2), (1, "not", 1, 3), (2, "a", 2, 0), (2, "b", 1, 0), (2, "c", 1, 1)}
    top = terms.top_terms(df, "doc_id", "text", 2, lambda w: w != "or")
    assert _plan(top).count("Exchange") == 1
    assert {(r.doc_id, r.word, r.n, r["rank"]) for r in top.where("doc_id = 1").collect()} == {(1, "to", 2, 1), (1, "be", 2, 2)}
