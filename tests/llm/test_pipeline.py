from collections import Counter

import pytest

import corpus_pipeline as pipeline

from .fixtures import documents
from .test_text_operators import ascii_words, brute_components, brute_drops, brute_quality, spans_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    base = tmp_path_factory.mktemp("pipeline")
    documents(spark).dropDuplicates(["doc_id"]).select(*COLUMNS).write.parquet(str(base / "documents.parquet"))
    docs, seen = spark.read.parquet(str(base / "documents.parquet")), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(base))
        out.write.parquet(str(base / name))
        out = spark.read.parquet(str(base / name))
        seen.append((name, docs, out))
        docs = out
    return base, seen


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secrets", "packing"]
    for _, _, out in stages[1][:-1]:
        assert out.columns == COLUMNS
        assert all(r.n_chars == len(r.text) for r in out.collect())


def test_each_stage_against_brute_force(stages):
    _, ((_, docs, kept), (_, _, lines), (_, _, unique), (_, _, clean), (_, _, packed)) = stages

    def passes(text):
        n, _, _, _, repeated = brute_quality(text)
        return n >= 50 and 100 * repeated <= 50 * n

    before = texts(docs)
    assert set(texts(kept)) <= {d for d, t in before.items() if passes(t)}
    soft = lambda t: (m := brute_quality(t))[2] > 0.1 * m[0] or not 3 <= m[1] / m[0] <= 10
    assert {d for d, t in before.items() if passes(t) and not soft(t)} <= set(texts(kept))

    before, drops = texts(kept), brute_drops([*texts(kept).items()])
    expected = {}
    for d, t in before.items():
        gone = {i for i, _ in drops[d]}
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or ascii_words(left):
            expected[d] = left
    assert texts(lines) == expected

    roots, _ = brute_components([*texts(lines).items()], 5)
    assert texts(unique) == {d: t for d, t in texts(lines).items() if roots[d] == d}
    for d, t in texts(clean).items():
        if not any(x[1] < 3 for x in spans_by_hand(texts(unique)[d])):
            assert t == texts(unique)[d] or "[SECRET]" in t
        else:
            assert "[SECRET]" in t
    assert set(texts(clean)) == set(texts(unique)) == {r.doc_id for r in packed.collect()}


def test_run_gives_the_last_stage(spark, stages):
    base, seen = stages
    want = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in seen[-1][2].collect())
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pipeline.run(spark, str(base)).collect()) == want
