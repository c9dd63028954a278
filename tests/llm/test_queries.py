"""The registered queries of the numbered operators over whole tables: against their SQL, the libraries they stand for, or labels."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from docmill.llm import bpe, language_id, queries

from .fixtures import SCHEMA, documents

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found, order: sorted(tuple(str(r[order.index(c)]) for c in columns) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_byte_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    assert bpe.GPT_PATTERN == public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = queries.op3_byte_bpe(spark, DATA).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_sharding(spark, texts):
    out = queries.op4_sharding(spark, DATA).collect()
    slots, loads, shards = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        shards[texts[r.doc_id]].add(r.shard)
    assert len(out) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads[s] for s in range(8)) <= max(r.size for r in out)
    assert max(map(len, shards.values())) == 1  # equal texts together


def test_language_id(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = queries.op5_language_id(spark, DATA).collect()
    assert len(out) == len(rows)
    right = Counter()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not language_id.has_letter(rows[r.doc_id].text):
            assert r.lang_pred == "und"
        elif r.held_out and rows[r.doc_id].lang:
            right[r.lang_pred == rows[r.doc_id].lang] += 1
    assert right[True] >= 0.95 * right.total() > 20


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = queries.op10_best_fit_packing(spark, DATA).collect()
    held, ends = defaultdict(dict), defaultdict(list)
    for r in out:
        held[r.doc_id][r.piece] = r
        ends[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 0], 0
        for piece in range(len(held[doc])):
            r = held[doc][piece]
            assert r.start == at and (r.length == 2048 or piece == 0) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(held[doc]) == 1)
    for parts in ends.values():
        places = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == places[:-1].tolist() and places[-1] <= 2048
    assert len(ends) <= 1.02 * sum(r.length for r in out) / 2048 + 1


def test_special_strings_are_ordinary_text():
    serialized = bpe.tokenizer_of_file(queries.vocabulary("byte_bpe_50k.json"))
    text = "before <|endoftext|> after"
    slow, fast = (bpe.encoder(serialized, by_rank).encode([text])[0] for by_rank in (False, True))
    assert slow == fast and 50256 not in np.frombuffer(slow, "<u4") and bpe.in_merge_order(serialized)
    assert not bpe.in_merge_order(serialized.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


def run_stages(spark, docs, path):
    """The stages over a table, each written and read again."""
    docs.write.parquet(f"{path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(path)).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append(docs)
    return seen


def test_pipeline_stands_odd_rows_and_columns(spark, tmp_path):
    long = documents(spark).where("length(text) > 300")
    nameless = long.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("doc_id", "source", "id") else F.concat("text", F.lit(" nobody")).alias("text") if f.name == "text" else F.col(f.name) for f in long.schema.fields))
    docs = documents(spark).unionByName(nameless).withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")))
    *stages, packed = run_stages(spark, docs, tmp_path)
    assert all(s.columns == docs.columns for s in stages) and stages[-1].count() > 10
    assert stages[-1].where("doc_id IS NULL").count() > 0
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in stages[-1].collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert all(s.count() == 0 for s in run_stages(spark, spark.createDataFrame([], SCHEMA), tmp_path))
