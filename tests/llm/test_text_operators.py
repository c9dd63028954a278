import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import bpe, line_dedup, near_dup, packing, quality, secrets, sharding
from docmill.llm.queries import vocabulary

from .fixtures import documents, none

BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def ascii_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_bpe_matches_tiktoken_and_round_trips(spark, docs, rows):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    own = bpe.tokenizer_of_ranks(path, bpe.GPT_PATTERN)
    out = bpe.decode(bpe.encode(docs, own, offsets=True), own).collect()
    expected = tiktoken.Encoding("own", pat_str=bpe.GPT_PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = Counter((d, t) for d, t, _ in rows)
    by_id = {d: t or "" for d, t, _ in rows}
    assert len(out) == len(rows) and len(texts) <= len(rows)
    for r in out:
        ids, text = expected.encode_ordinary(by_id[r.doc_id]), by_id[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded).decode() == text
        pieces = bpe.pieces_of(r.ids, bpe.token_bytes(own))
        assert "".join(pieces) == text and len(pieces) == len(ids)
        starts, place = [], 0
        for i in ids:
            starts.append(len(text.encode()[: place + 1].decode(errors="ignore")) if text.encode()[place] & 0xC0 == 0x80 else len(text.encode()[:place].decode()))
            place += len(expected.decode_single_token_bytes(i))
        for got, want, i in zip(r.starts, starts, ids):
            if text.encode()[:1] and got != want:
                assert expected.decode_single_token_bytes(i)[0] & 0xC0 == 0x80  # within a character: its start
    assert bpe.encode(none(spark), own).count() == 0


def test_sharding_by_bytes(spark, docs, rows):
    out = sharding.assign(docs, 8).collect()
    assert len(out) == len(rows)
    loads, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    text_of = {d: t for d, t, _ in rows}
    for r in out:
        raw = (text_of[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_text[text_of[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(loads.values()), max(r.size for r in out)
    assert max(loads.values()) - min(loads.values()) <= largest and set(loads) <= set(range(8)) and total
    small = [t for t in by_text if len((t or "").encode()) * 3 < total / 16]
    assert all(len(by_text[t]) == 1 for t in small)
    assert sharding.assign(none(spark), 8).count() == 0


def test_sharding_splits_a_text_that_outweighs_a_shard(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} of many") for i in range(3000)], "doc_id long, text string")
    sizes = [r.bytes for r in sharding.assign(df, 8).groupBy("shard").agg({"size": "sum"}).toDF("shard", "bytes").collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.02 * min(sizes)


def test_sharding_write(spark, docs, tmp_path):
    odd = docs.unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("_shard").distinct().count() == 4 and back.drop("_shard").columns == odd.columns
    assert Counter(map(tuple, back.drop("_shard").collect())) == Counter(map(tuple, odd.collect()))
    assert Counter((r.doc_id, r._shard) for r in back.collect()) == Counter((r.doc_id, r.shard) for r in sharding.assign(odd, 4).collect())


def test_sharding_subdivides_overfull_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES", 2)  # so coarse a sample leaves ranges overfull
    monkeypatch.setattr(sharding, "RANGES", 4)
    df = spark.createDataFrame([(i, f"text {i} " * (1 + i % 40)) for i in range(4000)], "doc_id long, text string")
    rows = sharding.row_sizes(df, "doc_id", "text").cache()
    total = rows.agg(F.sum("size")).first()[0]
    first = sharding.splitters(rows, total, 32, 1)
    more = sharding.subdivided(rows, first, total, 4000, 32, 1)
    most = lambda bounds: max(r.b for r in rows.groupBy(sharding.range_of(bounds)("key").alias("r")).agg(F.sum("size").alias("b")).collect())
    assert most(first) > sharding.OVERFULL * total / 32 >= most(more) and set(first) < set(more)
    loads = [r.b for r in sharding.assign(df, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) < 1.3 * min(loads)


def brute_quality(text):
    w = ascii_words(text)
    text = text or ""
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if ascii_words(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_quality_rules(spark, docs, rows):
    out = quality.judge(docs).collect()
    assert len(out) == len(rows)
    text_of = {d: t for d, t, _ in rows}
    for r in out:
        n, chars, symbols, dup, repeated = brute_quality(text_of[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert r.kept == (not r.base_failed and not (r.host_bad and r.soft_failed))
    left = quality.kept_documents(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert quality.judge(none(spark)).count() == 0 and quality.kept_documents(none(spark)).count() == 0


def test_host_prior_shrinks_small_hosts(spark):
    good = "the quick brown foxes jumped over lazier dogs again while " * 1
    clean = " ".join(f"word{i}x" for i in range(80))
    symbols = " ".join(f"word{i}x ###" for i in range(80))
    data = [(i, clean, "fine") for i in range(60)] + [(100 + i, symbols, "bad") for i in range(30)] + [(200 + i, good, "bad") for i in range(30)]
    data += [(300 + i, clean, f"site{i}") for i in range(20)] + [(400, symbols, "single"), (401, clean, "bad")]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert out[100].host_bad and not out[100].kept  # a soft failure on a condemned host
    assert out[401].kept  # a clean document stays wherever it is
    assert out[400].host_rate < 1 and not out[400].host_bad and out[0].kept  # one document condemns no host
    assert sum(r.kept != (not r.base_failed) for r in out.values()) == 30  # what the hosts' verdicts change


def test_prior():
    assert quality.prior(0, 0, 0.0, 0) == (1.0, 1.0)
    alike = quality.prior(20, 100, 100 * 0.04, 2)  # both hosts at the mean: chance explains more
    assert sum(alike) == pytest.approx(quality.PLAIN_STRENGTH) and alike[0] / sum(alike) == pytest.approx(0.2)
    apart = quality.prior(50, 100, 50.0, 2)  # one host fails wholly, one never
    assert sum(apart) == 2.0
    assert sum(quality.prior(500_000, 1_000_000, 250_001.0, 2)) <= quality.MOST_STRENGTH


def spans_by_hand(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end(), m.group(2)))
    found += [(m.start(), 1, m.end(), m.group()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), m.group()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", text):
        if all(re.search(c, m.group()) for c in ("[0-9]", "[A-Z]")) and not m.group().startswith("AKIA"):
            found.append((m.start(), 3, m.end(), m.group()))
    return sorted(found)


def test_secret_scan(spark, docs, rows):
    owners, repositories = defaultdict(set), defaultdict(set)
    for d, t, s in rows:
        for x in spans_by_hand(t):
            owners[x[3]] |= {s} - {None}
            repositories[x[3]].add(d)
    text_of = {d: t for d, t, _ in rows}
    report = lambda t: [x for x in spans_by_hand(t) if x[1] < 3 or len(owners[x[3]]) <= secrets.MOST_OWNERS and len(repositories[x[3]]) <= secrets.MOST_REPOSITORIES]
    out = secrets.scan(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s.start, s.nth, s.end) for s in r.spans] == [x[:3] for x in report(text_of[r.doc_id])], r
    assert any(s.nth == 3 for r in out for s in r.spans)
    wide = next(v for v in owners if v.startswith("zZ1"))
    assert len(owners[wide]) > secrets.MOST_OWNERS

    def by_hand(t):
        if t is None:
            return None
        merged = []
        for start, _, end, _ in report(t):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        for start, end in reversed(merged):
            t = t[:start] + secrets.MARK + t[end:]
        return t

    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((d, by_hand(t)) for d, t, _ in rows)
    assert secrets.scan(none(spark)).count() == 0 and secrets.redact(none(spark)).count() == 0


def test_copied_examples_are_not_live_whoever_holds_them(spark):
    token = lambda i: f"AbC{i}" * 8
    data = [(i, f"x {token(1)} y", "one") for i in range(9)]  # many documents of one owner
    data += [(20 + i, f"x {token(2)} y", f"o{i}") for i in range(3)]  # three owners
    data += [(30 + i, f"x {token(3)} y", "two") for i in range(5)] + [(35, f"x {token(3)} y", None)] * 2  # five documents and a sixth, of nobody
    data += [(40 + i, f"x {token(4)} y", f"p{i % 2}") for i in range(4)] + [(50, None, "q"), (51, None, "q")]
    out = {r.doc_id: len(r.spans) for r in secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert {i for i, n in out.items() if n} == {40, 41, 42, 43} and len(out) == 24


def test_secrets_of_a_text_of_megabytes(spark):
    parts = [f"secret: Value{i:06d} " + "pad " * 20 for i in range(12_000)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    got = [(s.start, s.nth, s.end) for s in secrets.scan(df).first().spans]
    assert got == [x[:3] for x in spans_by_hand(text)] and len(got) == 12_000
    assert secrets.redact(df).first().text == re.sub(r"secret: Value\d+", secrets.MARK, text)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute_drops(rows, least=line_dedup.LEAST_CHARS):
    first = {}
    for d, t in sorted({(d, t) for d, t in rows if t is not None}):
        for i, line in enumerate(t.split("\n")):
            if ascii_words(line):
                first.setdefault(line, (d, i))
    long = [x for x in first if len(x) >= least]
    near = {b for b in long if any(first[a] < first[b] and a != b and within_one(a, b) for a in long)}
    return {d: [(i, "exact" if (d, i) != first[x] else "near") for i, x in enumerate(t.split("\n")) if x in first and ((d, i) != first[x] or x in near)] for d, t in rows if t is not None}


def test_line_dedup(spark, docs, rows):
    expected = brute_drops([(d, t) for d, t, _ in rows])
    assert any(k == "near" for x in expected.values() for _, k in x) and any(k == "exact" for x in expected.values() for _, k in x)
    out = line_dedup.line_counts(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        want = expected.get(r.doc_id, [])
        assert r.dropped == ",".join(str(i) for i, _ in want), r
        assert (r.n_exact, r.n_near) == (sum(k == "exact" for _, k in want), sum(k == "near" for _, k in want))
    clean = line_dedup.deduplicate(docs)
    assert clean.columns == docs.columns
    by_hand = {}
    for d, t, _ in rows:
        gone = {i for i, _ in expected.get(d, [])}
        left = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or ascii_words(left):
            by_hand[d] = left
    assert {r.doc_id: r.text for r in clean.collect()} == by_hand
    assert line_dedup.line_counts(none(spark)).count() == 0 and line_dedup.deduplicate(none(spark)).count() == 0


def test_line_dedup_edits_at_every_place_and_long_lines(spark):
    base = "abcdefghij klmnopqrst uvwxyzabcd efghijklmn"
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    data = [(0, base), (1, long)]
    for i in (0, 1, 7, 8, 20, 21, 22, 41, 42):
        data += [(10 + i, base[:i] + "#" + base[i + 1 :] + "\n" + base[:i] + base[i + 1 :] + "\n" + base[:i] + "#" + base[i:])]
    data += [(100, base + "#"), (101, base + "##"), (102, long[:4990] + long[4991:]), (103, long[:63] + "#" + long[63:]), (104, long[:2500] + "##" + long[2502:])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    expected = brute_drops(data)
    got = {r.doc_id: r.dropped for r in line_dedup.line_counts(df).collect()}
    assert got == {d: ",".join(str(i) for i, _ in x) for d, x in expected.items()}


def test_line_dedup_of_short_and_very_long_lines(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(100_000))
    data = [(0, "short line\n\nEnd."), (1, "short line\n\nshort lino\n  \n"), (2, "End.\nEnd.\nEnd"), (3, None), (4, long), (5, long[:60_001] + long[60_002:]), (6, long[:-2] + "##")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.dropped) for r in line_dedup.line_counts(df).collect()} == {
        0: (3, 0, 0, ""), 1: (5, 1, 0, "0"), 2: (3, 2, 0, "0,1"), 3: (0, 0, 0, ""), 4: (1, 0, 0, ""), 5: (1, 0, 1, "0"), 6: (1, 0, 0, ""),
    }
    assert {r.doc_id: r.text for r in line_dedup.deduplicate(df).where("doc_id < 4").collect()} == {0: data[0][1], 1: "\nshort lino\n  \n", 2: "End", 3: None}


def shingle_set(text, width):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = ascii_words(w)
    width = min(width, len(w))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if w else frozenset()


def brute_components(rows, width, percent=80):
    sets = {d: shingle_set(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}, sets


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, docs, rows, width):
    expected, sets = brute_components([(d, t) for d, t, _ in rows], width)
    out = near_dup.near_duplicates(docs, width).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len({r.component_id for r in out}) < len(set(expected))
    assert near_dup.near_duplicates(none(spark), width).count() == 0


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    data = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i in range(300) for k in [rng.randrange(120)]]
    data += [(1000 + i, " ".join(f"u{rng.randint(0, 9999)}" for _ in range(60))) for i in range(40)]
    monkeypatch.setattr(near_dup, "REGION", 20)  # deeper regions and chunks
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()}
    assert out == brute_components(data, 4)[0]


def test_near_duplicates_of_a_hub_whose_copies_differ(spark):
    import random

    rng = random.Random(9)
    data = []
    for group in range(6):
        base = [f"g{group}w{rng.randint(0, 9999)}" for _ in range(150)]
        data.append((group * 100 + 50, " ".join(base)))
        for k in range(30):
            words = list(base)
            for at in rng.sample(range(5, 145, 10), 4):
                words[at] = f"new{k}x{at}"
            data.append((group * 100 + k, " ".join(words)))
    expected, sets = brute_components(data, 4)
    pairs = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(30) for b in range(a)]
    assert min(pairs) < 0.8 < len(sets[50] & sets[0]) / len(sets[50] | sets[0])
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()}
    assert out == expected


def template_corpus(n, twins, seed=5):
    """``n`` texts of one template under the bound of each other, and copies of the first ``twins`` of them just over it."""
    import random

    rng = random.Random(seed)
    template = [f"t{i}" for i in range(86)]
    data = [(i, template + [f"d{i}x{k}" for k in range(14)]) for i in range(n)]
    for i in range(twins):
        words = list(data[i][1])
        for at in (rng.randrange(5, 80), rng.randrange(88, 95)):
            words[at] = f"new{i}x{at}"
        data.append((n + i, words))
    return [(i, " ".join(words)) for i, words in data]


def test_near_duplicates_of_a_template_in_crowded_regions(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "REGION", 20)
    data = template_corpus(600, 80)
    expected, _ = brute_components(data, 5)
    assert sum(a != c for a, c in expected.items()) == 80
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out == expected


def test_near_duplicates_of_a_template_beyond_the_neighbours(spark):
    data = template_corpus(600, 80)  # its regions aren't crowded
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out == brute_components(data, 5)[0]


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    out = packing.pack(docs, bpe.tokenizer_of_file(path), 256, 0).collect()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t, _ in rows}
    pieces, sequences = Counter(), defaultdict(list)
    for r in out:
        own = ids[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        assert r.length == 256 or r.piece == 0
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter({d: 0 for d in ids}) + Counter(d for d, _, _ in rows for _ in range(len(ids[d])))
    for parts in sequences.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 256
    total = sum(r.length for r in out)
    assert len(sequences) <= 1.03 * total / 256 + 2
    assert packing.pack(none(spark), bpe.tokenizer_of_file(path), 256, 0).count() == 0


def test_packing_plan_uses_each_piece_once():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 2049, 20_000).tolist())
    recipes = packing.plan(dict(counts), 2048)
    used = Counter()
    for content, n in recipes:
        assert sum(content) <= 2048
        for x in content:
            used[x] += n
    bins, bound = sum(n for _, n in recipes), sum(k * v for k, v in counts.items()) / 2048
    assert used == counts and bins <= 1.01 * bound + 1
    solution = packing.fractional(np.array([0, 5, 9, 0, 3]))
    assert all(sum((np.arange(5) + 1) * c) <= 5 for c, _ in solution)
    assert (sum(c * x for c, x in solution) >= np.array([0, 5, 9, 0, 3]) - 1e-6).all()


def test_digest_of_queries(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    from docmill.llm import queries

    first = queries.op7_secret_scan(spark, str(tmp_path)).where("n_assign + n_access + n_hex = 0").first()
    assert first.base_sha256 == hashlib.sha256(b"").hexdigest()
