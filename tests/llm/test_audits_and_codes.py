"""Fingerprints, vector codes and the filter audit against brute force and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import filter_audit, fingerprints, vector_codes

from .fixtures import documents, none


def brute_sketch(text):
    """Every shingle hash one by one, then the threshold."""
    from docmill.llm.near_dup import shingles

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    width = min(5, len(words))
    each = {int(shingles(" ".join(words[i : i + width]), 5)[0]) >> 1 for i in range(len(words) - width + 1)} if words else set()
    low = sorted(h for h in each if h < 2**59)
    if len(low) < 64:
        low = sorted(each)[:64]
    return each, low


def test_sketch_keeps_what_lies_below_the_threshold():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 5, 60, 68, 69, 300, 4000):
        text = " ".join(f"W{x}" for x in rng.integers(0, 5000, n))
        each, low = brute_sketch(text)
        mark = fingerprints.sketch(text)
        assert mark.n_shingles == len(each) and mark.hashes.tolist() == low
        assert {h for h in each if h < mark.bound} == set(low)  # whole below its bound
        assert len(low) == len(each) or mark.bound >= 2**59


def test_likeness_estimates_the_whole_sets():
    rng = np.random.default_rng(2)
    errors = []
    for n in (40, 300, 2000, 8000):
        for share in (0.2, 0.5, 0.9):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            other = words[: int(n * share)] + [f"v{x}" for x in rng.integers(0, 10**6, n - int(n * share))]
            a, b = " ".join(words), " ".join(other)
            whole_a, whole_b = brute_sketch(a)[0], brute_sketch(b)[0]
            true = len(whole_a & whole_b) / len(whole_a | whole_b)
            errors.append(abs(fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)) - true))
            part = " ".join(words[: n // 4])
            assert fingerprints.containment(fingerprints.sketch(part), fingerprints.sketch(a)) == 1.0
    assert max(errors) < 0.15 and np.mean(errors) < 0.05


@pytest.mark.parametrize("bucket_rows", [8192, 7])
def test_documents_beside_the_next_ones(spark, bucket_rows):
    rows = [(r.doc_id, r.text or "") for r in documents(spark).collect()]
    out = fingerprints.beside_next(documents(spark), bucket_rows=bucket_rows).collect()
    assert len(out) == len(rows)
    ordered, found = sorted(rows), defaultdict(list)
    for r in out:
        found[r.doc_id].append(r)
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        gone = len(text) // 4
        changed = text[: len(text) - gone] + after[:gone]
        digest = hashlib.sha256(changed.encode()).hexdigest()
        r = next(r for r in found[doc] if r.edited_sha256 == digest)
        found[doc].remove(r)
        own, other, following = (fingerprints.sketch(t) for t in (text, changed, after))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own.text(), other.text())
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, other), fingerprints.likeness(own, following))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert not any(found.values())


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.beside_next(none(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    (r,) = fingerprints.beside_next(one).collect()
    assert r.near_next == 1.0 and r.n_chars == 13
    named = spark.createDataFrame([("b", "x y"), ("a", None), (None, "lost words"), (None, None)], "doc_id string, text string")
    out = {(r.doc_id, r.n_chars): r for r in fingerprints.beside_next(named).collect()}
    assert out["a", 0].near_edited == 1.0 and out["a", 0].near_next == 0.0 and out[None, 10].near_next is None and out[None, 10].near_edited == 1.0 and len(out) == 4
    many = spark.createDataFrame([(f"{i:04}", f"text {i}") for i in range(300)], "doc_id string, text string")
    assert fingerprints.beside_next(many, bucket_rows=20).count() == 300


def test_merged_sketches_hold_their_members(spark):
    rng = np.random.default_rng(3)
    texts = [(i, f"src{i % 2}", " ".join(f"w{x}" for x in rng.integers(0, 10**6, 50 + 400 * (i % 3)))) for i in range(12)]
    found = fingerprints.sketches(spark.createDataFrame(texts, "doc_id long, source string, text string"), keep=("source",))
    groups = fingerprints.merged(found, "source")
    union = defaultdict(set)
    for _, source, text in texts:
        union[source] |= brute_sketch(text)[0]
    held = defaultdict(set)
    for r in groups.collect():
        held[r.source].add(r.hash)
    for source, hashes in held.items():
        (bound,) = {r.bound for r in groups.where(F.col("source") == source).collect()}
        assert hashes == {h for h in union[source] if bound is None or h < bound} and hashes
    shares = {(r.doc_id, r.source): r.containment for r in fingerprints.contained(found, groups, "source").collect()}
    assert all(shares[i, source] == 1.0 for i, source, _ in texts)


def brute_codes(vectors, parts=4, entries=256, rounds=4):
    """One vector, part and entry at a time, in Python integers."""
    ids = sorted(vectors)
    width = len(vectors[ids[0]]) // parts
    cut = {i: [vectors[i][p * width : (p + 1) * width] for p in range(parts)] for i in ids}
    books = [[cut[i][p] for i in ids[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda x, p: min((far(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            given = defaultdict(list)
            for i in ids:
                given[best(cut[i][p], p)[1]].append(cut[i][p])
            for k, xs in given.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    coded = {i: [best(cut[i][p], p) for p in range(parts)] for i in ids}
    return books, {i: ([k for _, k in c], sum(d for d, _ in c)) for i, c in coded.items()}


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = {i: np.round(rng.normal(size=8), 2).tolist() for i in range(90)}
    vectors[91] = vectors[90] = vectors[3]  # ties
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in vectors.items()] + [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [float("nan")] * 8, None), (203, [float("inf")] * 8, 2), (204, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    ints = vector_codes.integers(df, keep=("label",))
    books = vector_codes.fit(ints, entries=16)
    want_books, want = brute_codes({i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors.items()}, entries=16)
    assert books.entries.tolist() == want_books
    coded = vector_codes.with_group_error(vector_codes.encode(ints, books), "label")
    got = {r.id: r for r in coded.withColumn("hex", vector_codes.hex_code()).collect()}
    assert {i: (r.codes, r.error) for i, r in got.items()} == want
    sums = Counter()
    for r in got.values():
        sums[r.label] += r.error
    assert all(r.group_error == sums[r.label] and r.hex == "".join(f"{k:02x}" for k in r.codes) for r in got.values())
    assert all(abs(x - y) < 3 for r in vector_codes.decode(coded, books).collect() for x, y in zip(r.vector, vectors[r.id]))


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int, kept string, id int, codes string"
    empty = vector_codes.integers(spark.createDataFrame([], schema))
    assert vector_codes.encode(empty, vector_codes.fit(empty)).count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "a", 1, "b"), (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "a", 1, "b"), (None, [1e30, -1e30, 0.0, 0.0, 0.0], None, "a", 1, "b"), (2, [], 1, "a", 1, "b")]
    ints = vector_codes.integers(spark.createDataFrame(rows, schema), keep=("label", "kept"))
    out = vector_codes.encode(ints, vector_codes.fit(ints)).collect()
    assert sorted(str(r.id) for r in out) == ["1", "1", "None"] and all(r.kept == "a" for r in out)
    assert [r.error for r in out if r.id == 1] == [0, 0]  # two entries are these vectors


def brute_audit(rows, labels):
    """Every order applied to every document, one filter after the other."""
    quality, toxic = ({d for d, *flags in labels if d is not None and flags[k] == 1} for k in (0, 1))
    fails = []
    for doc, source, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        checks = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]
        copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, _, t in rows)
        fails.append((doc, source or "", "".join(f for f, c in zip("ABCDE", [*checks, copy]) if c)))
    out = Counter()
    for part in {p for _, p, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(d, f) for d, p, f in fails if p == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                key = (part, "".join(order), step)
                unique = sum(f == letter for _, f in everyone)
                out[key] = (len(left), len(gone), sum(letter in f for _, f in everyone) - len(gone), unique, sum(d in quality for d in gone), sum(d in toxic for d in gone))
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_every_order_tried(spark):
    docs = documents(spark).unionByName(documents(spark).limit(4).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"mask": F.lit(1), "hashes": F.lit("x"), "first": F.lit(2), "words": F.lit("w")})
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want = brute_audit(rows, [tuple(r) for r in labels.collect()])
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(docs, labels).collect()}
    assert got == want
    assert filter_audit.audit(none(spark), labels).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_copies_by_partition_refinement(spark, bits):
    """Copies of long texts that agree in their first blocks; with hashes of 3 bits nearly all classes collide."""
    base = "lorem ipsum " * 600
    texts = [base + str(i % 4) for i in range(20)] + [base[:300] + "x" + base[301:], base[:300] + "y" + base[301:], "", None, "", "same length a", "same length b", "same length a", "é" * 5000, "é" * 5000]
    rows = spark.createDataFrame([(100 - i, t, "s") for i, t in enumerate(texts)] + [(81, base + "3", "s"), (81, "another text", "s"), (None, "same length a", "s")], "doc_id long, text string, source string")
    got = filter_audit.failures(rows, bits=bits).collect()
    held = [(r.doc_id, r.text or "") for r in rows.collect()]
    want = Counter((d, d is not None and any(e is not None and e < d and t == u for e, u in held)) for d, t in held)
    assert Counter((r.doc_id, bool(r.mask & 16)) for r in got) == want
