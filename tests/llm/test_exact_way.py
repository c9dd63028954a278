"""The exact way of near-duplicates on texts of one template: candidates follow the nodes, and no link is lost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docmill.llm import near_dup

from .test_text_operators import brute_components


def filled(n: int, alternatives: int, slots: int = 8) -> list[str]:
    """Texts of a template with slots of four words, all different."""
    rng = random.Random(5)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    choices = [[words(4) for _ in range(alternatives)] for _ in range(slots)]
    fixed, out = [words(8) for _ in range(slots + 1)], set()
    while len(out) < n:
        out.add(" ".join(x for k in range(slots) for x in (fixed[k], choices[k][rng.randrange(alternatives)])) + " " + fixed[slots])
    return sorted(out)


def candidates(spark, texts: list[str]):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dup.signatures(docs, 4, "doc_id", "text")
    nodes = near_dup.materialize(rows.select("set_id", "n_shingles", F.col("set_id").alias("root"), "signature"), "nodes")
    return near_dup.materialize(near_dup.exact_pairs(nodes, near_dup.materialize(near_dup.full_sets(docs, 4, "text"), "sets"), 80), "pairs")


def test_candidates_of_a_template_follow_its_texts(spark):
    few, many = (candidates(spark, filled(n, 30)).count() for n in (500, 2000))
    assert few <= 16 * 500 and many <= 16 * 2000  # all pairs would be 124,750 and 1,999,000


@pytest.mark.parametrize("alike", [0.0, 1.1])
def test_no_link_is_lost(spark, monkeypatch, alike):
    """With buckets never divided and always divided: all pairs of the similarity, or the same components by a bucket's least node."""
    monkeypatch.setattr(near_dup, "ALIKE", alike)
    texts = filled(220, 5)
    sets = [set(near_dup.shingles(t, 4).tolist()) for t in texts]
    ids = [near_dup.set_id(near_dup.shingles(t, 4)) for t in texts]
    linked = {tuple(sorted((ids[i], ids[j]))) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = {(r.a, r.b) for r in candidates(spark, texts).collect()}

    def components(pairs):
        parent = {i: i for i in ids}
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in sorted(pairs):
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in ids}

    assert components(got & linked) == components(linked) and linked


def test_components_with_always_divided_buckets(spark, monkeypatch):
    """Twins, chains and a crowd of one template with the exact way forced on: regions of any size stay unsettled."""
    monkeypatch.setattr(near_dup, "ALIKE", 1.1)
    monkeypatch.setattr(near_dup, "MEET", 2)
    monkeypatch.setattr(near_dup, "REGION", 20)
    texts = filled(150, 4)
    texts += [t + " tail" for t in texts[:20]] + [t.replace(t.split()[3], "x", 1) for t in texts[20:40]] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 4, 80).collect()}
    assert got == brute_components(list(enumerate(texts)), 4)[0]


def test_shuffle_files_of_written_tables_go(spark):
    """whatever a written table has shuffled is deleted when it stands, not when the driver's garbage collector comes by."""
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    told = spark.conf.get(setting, None)
    written = near_dup.materialize(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).agg(F.sum("id").alias("n")), "sums")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and written.count() == 97 and spark.conf.get(setting, None) == told


@pytest.mark.parametrize("words", [1, 64, 1 << 18])
def test_rows_are_looked_up_by_a_filter_first(spark, monkeypatch, words):
    """texts whose id has no bit in the filter don't move; whatever the filter's size, the rows are those of the ids."""
    monkeypatch.setattr(near_dup, "FILTER_WORDS", words)
    rows = spark.createDataFrame([(i % 900, f"t{i}") for i in range(1800)] + [(None, "none")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 7)], "doc_id long")
    got = near_dup.holding(rows, ids, "doc_id")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i % 900, f"t{i}") for i in range(1800) if i % 900 % 7 == 0)
    assert near_dup.holding(rows, ids.limit(0), "doc_id").count() == 0
