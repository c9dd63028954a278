"""Exact, near and semantic deduplication of documents.

Exact groups share the hash of the comparable form. Every decision is one hash aggregate plus a join back on
the hash, so a group of any size is pre-aggregated before it moves.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.hashing import comparable, content_hash, fingerprint, threshold
from docmill.functions.text import once
from docmill.operators import similar

#: Fixed value: characters below which a text is never a duplicate.
LEAST_CHARS = similar.LEAST_CHARS


def flag_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, algorithm: str = "sha256", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, content_hash, ``original_id`` (the smallest id with the same hash), ``is_duplicate`` and the columns to ``keep``. Short texts are never duplicates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), content_hash(text, algorithm).alias("content_hash"), (F.length(F.trim(text)) < least_chars).alias("short"), F.struct(F.lit(0), *keep).alias("kept"))
    first = rows.where("NOT short").groupBy("content_hash").agg(F.min("id").alias("original_id"))
    out = rows.join(first, "content_hash", "left").withColumn("original_id", F.when(F.col("short"), F.col("id")).otherwise(F.col("original_id")))
    return out.select(F.col("id").alias(id_col), "content_hash", "original_id", (F.col("id") != F.col("original_id")).alias("is_duplicate"), *(F.col("kept")[c].alias(c) for c in keep))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``df`` without later copies: short texts and the rows of the smallest id of each hash. Rows that share an id stay or go together.

    Texts are hashed in one aggregate; the rows are then joined once, by id.
    """
    short = lambda text: F.length(F.trim(F.coalesce(text, F.lit("")))) < least_chars
    hashed = df.where(~short(F.col(text_col))).select(F.col(id_col).alias("_id"), content_hash(text_col).alias("_hash"))
    first = hashed.groupBy("_hash").agg(F.min("_id").alias("_id")).select("_id").distinct()
    return df.join(first, df[id_col] == first["_id"], "left").where(short(df[text_col]) | F.col("_id").isNotNull()).select(*(df[c] for c in df.columns))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", published_col: str | None = None) -> DataFrame:
    """content_hash, representative, document_count, lengths and, if asked, first and last time of each group of two or more equal contents.

    Groups by a hash similarity of 0.85 are these: two different SHA-256 digests agree so far less than once in 10 ** 20.
    """
    times = [F.col(published_col).alias("at")] if published_col else []
    marks = once(comparable(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.struct(F.when(t == "", F.lit("")).otherwise(F.sha2(t, 256)).alias("content_hash"), F.length(t).cast("long").alias("chars")))
    groups = df.select(F.col(id_col).alias("id"), marks.alias("m"), *times).select("id", "m.*", *(["at"] if times else [])).groupBy("content_hash")
    ends = [F.min("at").alias("min_published_at"), F.max("at").alias("max_published_at")] if published_col else []
    out = groups.agg(F.min("id").alias("representative"), F.count("*").alias("document_count"), F.sum("chars").alias("total_length"), F.avg("chars").alias("avg_length"), *ends)
    return out.where("document_count > 1")


def similar_documents(df: DataFrame, queries: DataFrame, k: int = 5, least: float | str = "normal", id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """The stored documents themselves for each query: query_id, rank, score and the columns of ``df`` but the vector."""
    found = similar_vectors(df, queries, k, threshold(least), id_col, vector_col)
    return found.join(df.drop(vector_col), id_col)


def not_seen(df: DataFrame, seen: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose content hash isn't in ``seen`` (content_hash): a batch against a stored set."""
    rows = df.withColumn("content_hash", content_hash(text_col))
    return rows.join(seen.select("content_hash").distinct(), "content_hash", "left_anti")


def similar_flags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | str = "normal", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id and ``is_similar``: whether a document of a smaller id has a weighted score (hash, length, words, structure) of ``least`` or more; ``similar.best_similar`` names it."""
    return similar.has_similar(df, id_col, text_col, least, least_chars)


def is_duplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, least: float | str = "normal", least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, ``is_duplicate`` and ``method``: an earlier document has the same title, the same content, or a similar one. Short texts are no duplicates."""
    flags = flag_duplicates(df, id_col, text_col, least_chars).select(F.col(id_col).alias("id"), F.col("is_duplicate").alias("content"))
    flags = flags.groupBy("id").agg(F.bool_or("content").alias("content"))
    similar = similar_flags(df, id_col, text_col, least, least_chars).select(F.col(id_col).alias("id"), F.col("is_similar").alias("similar")).groupBy("id").agg(F.bool_or("similar").alias("similar"))
    both = flags.join(similar, "id")
    method = F.when(F.col("content"), "content").when(F.col("similar"), "similar")
    if title_col:
        long = df.where((F.length(F.trim(text_col)) >= least_chars) & (F.trim(title_col) != "")).select(F.col(id_col).alias("id"), content_hash(title_col).alias("t"))
        titled = long.join(long.groupBy("t").agg(F.min("id").alias("least")), "t").where("id != least").select("id").distinct().withColumn("title", F.lit(True))
        both, method = both.join(titled, "id", "left"), F.when(F.col("title"), "title").otherwise(method)
    return both.select(F.col("id").alias(id_col), method.isNotNull().alias("is_duplicate"), method.alias("method"))


#: The signature table: what is known of documents that were seen.
SIGNATURES = "doc_id STRING, content_hash STRING, title_hash STRING, content_length INT, word_count INT"


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """The rows of a signature table for documents of any length."""
    marks = fingerprint(F.col(text_col), F.col(title_col) if title_col else None)
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), marks.alias("f"))
    return rows.select("doc_id", *(F.col(f"f.{c}") for c in ("content_hash", "title_hash", "content_length", "word_count")))


def add_signatures(known: DataFrame, df: DataFrame, **columns: str) -> DataFrame:
    """``known`` with the signatures of ``df``; documents that it has already get their new ones."""
    new = signatures(df, **columns)
    return known.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def remove_signatures(known: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return known.join(ids.select(F.col(id_col).cast("string").alias("doc_id")), "doc_id", "left_anti")


def save_signatures(known: DataFrame, path: str) -> None:
    """JSON lines under a new path, so that a table can be saved while it is read from elsewhere."""
    known.write.json(path)


def load_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNATURES).json(path)


def similar_vectors(df: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, part_rows: int = 8192, few_rows: int = 64) -> DataFrame:
    """query_id, rank, id and score of the k rows of ``df`` with the highest cosine of ``least`` or more.

    Rows are cut into parts and queries into blocks; each part meets each block once, ``few_rows`` queries at a time, as products of
    matrices of unit vectors, and keeps k rows a query. Null vectors take no part; vectors meet those of their own
    length; null components and zero vectors have cosine 0 with everything.
    """
    n, m = df.count(), queries.count()
    blocks, parts = max(1, -(-m // block_rows)), max(1, -(-n // part_rows), min(-(-n // 512), df.sparkSession.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda d: d.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.size(vector_col).alias("dim"))
    held = some(df).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    posed = some(queries).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))

    def units(vectors: pd.Series) -> np.ndarray:
        raw = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
        lengths = np.sqrt((raw * raw).sum(1, keepdims=True))
        return np.where(np.isfinite(lengths) & (lengths > 0), raw / np.where(lengths > 0, lengths, 1), 0.0)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x, q = left["id"].to_numpy(), units(left["v"]), units(right["v"])
            for own, unit, rough in zip(right["id"], q, chain.from_iterable(q[i : i + few_rows] @ x.T for i in range(0, len(q), few_rows))):
                bar = max(least, np.partition(rough, -k - 1)[-k - 1] if len(rough) > k else -2) - 1e-9  # one more, for the query itself
                at = np.flatnonzero((rough >= bar) & (ids != own))
                exact = (x[at] * unit).sum(1)  # in one order for every row, so equal vectors tie
                best = np.lexsort((ids[at], -exact))[:k]
                out += [(own, ids[at[i]], exact[i]) for i in best if exact[i] >= least]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    keys, kind = ["dim", "part", "block"], held.schema["id"].dataType.simpleString()
    scored = held.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInPandas(meet, f"query_id {kind}, id {kind}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def dedup_stats(flags: DataFrame, *by: str) -> DataFrame:
    """Totals, duplicates and rates of flagged rows, by group."""
    out = flags.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("is_duplicate").alias("duplicates"))
    return out.withColumns({"unique_docs": F.col("total") - F.col("duplicates"), "duplicate_rate": F.col("duplicates") / F.col("total")})


def duplicate_stats(df: DataFrame, *by: str, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Totals, duplicates and rates by group, straight from the texts: one aggregate over hash and group, so no row is flagged or joined.

    Of each content that is long enough one row is unique, in the group that has its smallest id; short texts all are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.when(F.length(F.trim(text)) >= least_chars, content_hash(text)).alias("_hash")
    held = df.select(hashed, F.col(id_col).alias("_id"), *by).groupBy("_hash", *by).agg(F.count("*").alias("n"), F.min("_id").alias("least"))
    first = F.min("least").over(Window.partitionBy("_hash"))
    own = F.when(F.col("_hash").isNull(), F.col("n")).when(F.col("least").eqNullSafe(first), 1).otherwise(0)
    out = held.withColumn("own", own).groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") - F.col("own")).alias("duplicates"), F.sum("own").alias("unique_docs"))
    return out.withColumn("duplicate_rate", F.col("duplicates") / F.col("total"))


def semantic_duplicates(docs: DataFrame, known: DataFrame, least: float = 0.85, id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding", others: bool = False) -> DataFrame:
    """id, original_id and method of documents that a known one matches: by hash first, then by the best cosine of ``least`` or more.

    Texts under ``LEAST_CHARS`` are never duplicates; an id that is known is a duplicate of itself, or with
    ``others`` only of known rows of other ids.
    """
    long = docs.where(F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) >= LEAST_CHARS).withColumn("_hash", content_hash(text_col))
    keys = known.select(content_hash(text_col).alias("_hash"), F.col(id_col).alias("_known"))
    seen = keys.groupBy("_hash").agg(F.min("_known").alias("original_id"))
    itself = docs.join(known.select(id_col), id_col, "left_semi").select(id_col, F.col(id_col).alias("original_id"), F.lit("id").alias("method"))
    if others:
        itself = itself.where("false")
        second = keys.join(seen, "_hash").where("_known != original_id").groupBy("_hash").agg(F.min("_known").alias("_second"))
        seen = seen.join(second, "_hash", "left")
        original = F.when(F.col(id_col) == F.col("original_id"), F.col("_second")).otherwise(F.col("original_id"))
    else:
        original = F.col("original_id")
    equal = long.join(itself.select(id_col), id_col, "left_anti").join(seen, "_hash").select(id_col, original.alias("original_id"), F.lit("hash").alias("method")).where("original_id IS NOT NULL")
    rest = long.join(itself.union(equal).select(id_col), id_col, "left_anti").select(id_col, vector_col)
    best = similar_vectors(known.select(id_col, vector_col), rest, 1, least, id_col, vector_col)
    near = best.select(F.col("query_id").alias(id_col), F.col(id_col).alias("original_id"), F.lit("vector").alias("method"))
    return itself.union(equal).union(near)
