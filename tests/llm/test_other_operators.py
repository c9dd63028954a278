import math
import random

import numpy as np

from docmill.llm import language_id, search, url_filter
from docmill.llm.graph import components

from .fixtures import documents, none

VECTORS = "vec_id long, embedding array<float>, shard string, terms int"


def vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], "s", i) for i in range(400)]
    rows += [(500 + i, rows[7][1], "s", i) for i in range(60)]  # one common vector: ties
    rows += [(600, None, "s", 0), (650, [1.0, None] + [0.5] * 22, "s", 0), (700, [float("nan")] + [0.5] * 23, "s", 0), (750, [float("inf")] + [0.5] * 23, "s", 0), (800, [], "s", 0)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_search_equals_brute_force(spark, monkeypatch):
    for name, n in (("SHARD_ROWS", 64), ("LEAST_ROWS", 64), ("FIRST_ROWS", 50), ("BLOCK_ROWS", 4)):
        monkeypatch.setattr(search, name, n)
    rows, df = vectors(spark)
    good = [(i, np.floor(np.array([np.float32(x) for x in v], np.float64) * 256).astype(int)) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, w in good:
        if q % 50 == 0:
            scored = sorted((-int(w @ x), i) for i, x in good if i != q and len(x) == len(w))
            expected |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])}
    nameless = spark.createDataFrame([(None, rows[7][1], "s", 0)], VECTORS)
    df = df.unionByName(nameless)
    out = search.search(df, df.where("vec_id % 50 = 0 OR vec_id IS NULL"), 5)
    assert {tuple(r) for r in out.collect()} == expected and out.columns == ["query_id", "rank", "vec_id", "score"]
    assert search.search(df.limit(0), df.limit(0), 5).count() == 0


def test_search_prunes_nothing_that_counts():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.integers(-50, 50, (80, 40)) * (rng.random((80, 40)) < 0.3)
        q = rng.integers(-50, 50, 40)
        at, score = search.best_in_shard(np.arange(80), x.T.astype(float), 3, q.astype(float), 5)
        want = sorted((-int(q @ x[i]), i) for i in range(80) if i != 3)[:5]
        assert [(-int(s), int(i)) for i, s in zip(at, score)] == want
        least = -want[2][0]  # a threshold from elsewhere: what is below it goes, ties stay
        at, score = search.best_in_shard(np.arange(80), x.T.astype(float), 3, q.astype(float), 5, least)
        assert [(-int(s), int(i)) for i, s in zip(at, score)] == [w for w in want if -w[0] >= least]


def test_essential_terms_follow_the_threshold():
    top = np.array([50.0, 30.0, 10.0, 5.0])
    assert search.essential(top, -np.inf) == 4 and search.essential(top, 0.5) == 4
    assert search.essential(top, 16) == 2 and search.essential(top, 45) == 2 and search.essential(top, 46) == 1 and search.essential(top, 96) == 0


def test_rules_and_index():
    rules = url_filter.read_rules(url_filter.RULES.splitlines())
    assert [r.name for r in rules[:2]] == ["org/", "example.org/es/"] and len(rules) == 13
    index = url_filter.index_of(rules, {"org": 900, "example": 1000, "es": 5, "com": 400, "fr": 7, "de": 9, "en": 600, "casino": 1})
    assert [r.name for r in index["es"]] == ["example.org/es/"] and [r.name for r in index["en"]] == ["example.org/en/1"]
    judge = lambda u: url_filter.verdict_of(u, index)
    assert judge("HTTP://A.Example.ORG/en/12?x#y") == ("a.example.org", "/en/12", "example.org/en/1", "block", None)
    assert judge("https://example.org/EN/1")[2:4] == ("org/", "allow")
    assert judge("x://badexample.org/es/1")[2] == "org/"
    assert judge("x://example.org")[2:4] == (None, "allow")  # no path: no rule fits
    assert judge("x://example.org?/es/")[0:2] == ("example.org", "")
    assert judge("x://a.com/fr/1")[3] == "allow" and judge("x://a.com:80/fr/1")[2] is None
    assert judge("http://m.casino-win.net/x")[3:] == ("block", "||casino-*.") and judge("http://casino-museum.net/x")[3:] == ("allow", "@@||casino-museum.")
    assert judge("http://casinoroyal.net/x")[3:] == ("allow", None) and judge("http://cheap-PILLS.net")[4] == "-pills."
    assert judge("http://x.net/sponsored/a/b/redirect")[3] == "block" == judge("http://x.net/Sponsored//redirect?z")[3] and judge("http://x.net/sponsored/a/redirect/b")[3] == "allow"
    assert judge(None)[:3] == ("", "", None) and judge("no scheme/org/")[:3] == ("", "", None) and judge("")[3] == "allow"
    assert judge("a://b.com/x://c.org/es/")[0] == "b.com"


def test_pattern_syntax():
    matches = lambda line, place: url_filter.compiled(url_filter.pattern_rule(line).regex).search(place) is not None
    assert matches("||ads.net^", "ads.net/x") and matches("||ads.net^", "a.ads.net") and not matches("||ads.net^", "bads.net/") and not matches("||ads.net^", "ads.net.org/")
    assert matches("|ads.", "ads.net/") and not matches("|ads.", "x.ads.net/") and matches("/a*z|", "h/abz") and not matches("/a*z|", "h/abzy")
    of = lambda line: url_filter.pattern_rule(line).literals
    assert of("||ads.net^") == ("ads", "net") and of("banner") == ("~ann", "~ban", "~ner", "~nne") and of("/ads/ban*") == ("ads",) and of("*") == ()
    assert url_filter.site_rule("block", "net").regex.endswith("net(?=/|$)") and not url_filter.read_rules(["! comment", "", " "])


def test_large_rule_tables_are_joined(spark, tmp_path):
    rng = random.Random(4)
    hosts = [f"site{i}.{rng.choice(('com', 'net', 'org'))}" for i in range(400)]
    lines = [f"{rng.choice(('allow', 'block'))} {h}/{rng.choice(('', 'a/', 'b'))}" for h in hosts] * 2 + [f"||{h}^" for h in hosts[::3]] + [f"@@||{h}/*/ok|" for h in hosts[::5]] + [f"/track{i}/" for i in range(3000)]
    lines += ["banner", "pixel*gif", "*", url_filter.RULES]
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    rules = url_filter.rules_of_file(spark, str(tmp_path / "rules.txt"))
    assert len(rules) > 3500
    some = lambda: rng.choice(("a/x", "b", "bb/ok", "track7/", "myBANNERs", "z/ok", "", "pixel.GIF"))
    urls = [f"http://{rng.choice(('', 'www.'))}{rng.choice(hosts)}/{some()}" for _ in range(300)] + [None, "", "nothing"] * 2 + ["http://x.y/banner"] * 50
    df = spark.createDataFrame([(None if i == 9 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    here, joined = (sorted(map(str, url_filter.judge(df, rules, most_broadcast=n).collect())) for n in (10_000, 10))
    assert here == joined and len(here) == len(urls)
    fits = lambda u: [r for r in rules if (place := "".join(url_filter.parts(u))) and url_filter.compiled(r.regex).search(place)]
    slow = {u: (*url_filter.parts(u), *url_filter.best_of(fits(u))) for u in urls}
    assert all(tuple(r)[1:] == slow[urls[9 if r.page_id is None else r.page_id]] for r in url_filter.judge(df, rules).collect())
    assert {v[3] for v in slow.values()} == {"allow", "block"} and len({v[2] for v in slow.values()}) > 20 and len({v[4] for v in slow.values()}) > 5
    assert url_filter.judge(df.limit(0), rules, most_broadcast=10).count() == 0 and {r.verdict for r in url_filter.judge(df, ()).collect()} == {"allow"}


def test_url_filter_table(spark):
    urls = [None, "", "http://ExÄmple.ORG/", "http://x.org/es/" + "a" * 50_000, "http://cheap-pills.net/de/", "http://x.com/de/"] * 2
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert len(out) == 12 and out[2] == ("exÄmple.org", "org/", "allow") and out[4] == ("cheap-pills.net", None, "block") and out[5][1:] == ("com/de/", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def slow_code_length(text: bytes, counts, lang):
    """Prediction by partial matching with exclusion, symbol by symbol."""
    tables = [{} for _ in range(4)]
    for code, n in counts[counts["lang"] == lang][["code", "n"]].itertuples(index=False):
        raw = int(code).to_bytes(4, "big")
        for order in range(4):
            tables[order].setdefault(raw[3 - order : 3], {}).setdefault(raw[3], 0)
            tables[order][raw[3 - order : 3]][raw[3]] += n
    bits = 0.0
    for i in range(3, len(text)):
        excluded: set[int] = set()
        for order in (3, 2, 1, 0):
            free = {s: n for s, n in tables[order].get(text[i - order : i], {}).items() if s not in excluded}
            total = sum(free.values()) + len(free)
            if text[i] in free:
                bits -= math.log2(free[text[i]] / total)
                break
            if free:
                bits -= math.log2(len(free) / total)
            excluded |= tables[order].get(text[i - order : i], {}).keys()
        else:
            bits += math.log2(256 - len(tables[0][b""]))
    return bits


def test_language_id(spark):
    rng = random.Random(1)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)] for lang, letters in (("aa", "abcdeë"), ("bb", "efghab"), ("cc", "абвгд"))}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n)).capitalize()
    rows = [(i, text(lang := ("aa", "bb", "cc")[i % 3], 30), lang, "x") for i in range(120)]
    odd = [(200, None), (201, ""), (202, "123 !!! ²"), (203, "ZZZ qqq"), (204, text("bb", 20_000)), (205, "a")]
    df = spark.createDataFrame(rows + [(i, t, None, "x") for i, t in odd] + [rows[0]], "doc_id long, text string, lang string, score string")
    counts = language_id.fit(df.where(~language_id.held_out()))
    out = language_id.predict(df, counts).collect()
    assert len(out) == len(rows) + len(odd) + 1
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang, _ in rows)
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[203][0] in vocab and got[204][0] == "bb"
    trees = language_id.Trees(counts)
    for sample in ("Abc dee 12 zz", "хх абв", "ë", "efgh  ab"):
        raw = language_id.folded(sample)
        assert np.allclose(trees.code_lengths([raw])[0], [slow_code_length(raw, counts, lang) for lang in trees.langs], rtol=1e-5)
    nothing = language_id.predict(df, language_id.fit(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and language_id.predict(df.limit(0), counts).count() == 0


def test_language_id_stands_the_common_fixture(spark):
    docs = documents(spark)
    counts = language_id.fit(docs)
    assert language_id.predict(docs, counts).count() == docs.count() and language_id.predict(none(spark), counts).count() == 0


def test_components_of_a_path(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(900, 901)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(200)} | {(900, 900), (901, 900)}


def test_written_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    from docmill.llm import common

    assert common.tables_dir(spark).startswith(common.shared_dir(spark).rstrip("/"))
    monkeypatch.setattr(common, "tables_dir", lambda _: str(tmp_path / "tables"))
    assert common.materialize(spark.range(3).toDF("id"), "three").count() == 3 and (tmp_path / "tables").is_dir()
    common.clear(spark)
    assert not (tmp_path / "tables").exists()
