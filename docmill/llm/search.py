"""Exact top-k search by MaxScore over shards.

A query is a list of weighted terms, here one for each dimension. In a shard the largest and smallest
weight of a term bound what it can add to a score, so terms are ordered by what they can add at most. The
threshold is a score that the query's k-th best vector has at least: a first shard is searched for every query
and its k-th score goes along to all the others, where it rises as vectors are scored. The terms at the end
of the order whose bounds together stay below the threshold are non-essential: a vector that gets nothing
from the others can't reach it. Postings of the essential terms are traversed; the others are probed, a few at a
time, only for vectors whose score so far and the bounds of the terms that are left still reach the threshold.
Scores that remain are exact. Each shard returns its k best above the threshold, and these are merged.

Shards and blocks of queries have a bounded number of rows, and each block meets each shard once: what moves
is a row for each candidate and block of ``BLOCK_ROWS`` queries, and for each query and shard.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a
null id; vectors meet those of their own dimension; rows that repeat an id are separate candidates, as queries
they share one list of k, and none of them is a candidate for its own id; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard at most and of the first one, of a block of queries, and terms probed at a time.
SHARD_ROWS, FIRST_ROWS, BLOCK_ROWS, STEP = 16_384, 1024, 4096, 8
#: Rows of a shard at least, where smaller ones keep all cores busy.
LEAST_ROWS = 1024


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, terms (floor of ``scale`` times each component) and dim of the vectors that take part."""
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), value.alias("value"))
    return rows.select("id", F.transform("value", lambda x: F.floor(x * scale)).alias("terms"), F.size("value").alias("dim"))


def essential(top: np.ndarray, threshold: float) -> int:
    """How many terms, in the order of what they add at most, are essential: the rest together stays below the threshold."""
    rest = np.append(np.cumsum(top[::-1])[::-1], 0)
    return int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(top)


def best_in_shard(ids: np.ndarray, postings: np.ndarray, own: int, query: np.ndarray, k: int, threshold: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best vectors of ``threshold`` or more, postings being a row for each term."""
    live = np.flatnonzero(ids != own)
    ends = np.stack([query * postings.max(1), query * postings.min(1)]) if len(query) and len(live) else np.zeros((2, 0), postings.dtype)
    top, low = ends.max(0), ends.min(0)
    order = np.argsort(-top, kind="stable")
    at = essential(top[order], threshold)
    score = (query[order[:at]] @ postings[order[:at]])[live] if at else np.zeros(len(live), postings.dtype)
    while True:
        rest = order[at:]
        if len(live) > k:  # the k-th best so far gets at least the lowest of what is left
            threshold = max(threshold, np.partition(score, len(score) - k)[len(score) - k] + low[rest].sum())
        keep = score + top[rest].sum() >= threshold
        live, score = live[keep], score[keep]
        if not len(rest) or not len(live):
            break
        probed = rest[:STEP]
        score = score + query[probed] @ postings[np.ix_(probed, live)]
        at += STEP
    best = np.lexsort((ids[live], -score))[:k]
    return live[best], score[best]


def meeting(k: int):
    """A cogroup function: a shard of candidates and a block of queries, each with its threshold."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            ids, weights = left["id"].to_numpy(), np.stack(left["terms"].tolist()).astype(np.int64)
            wanted = np.stack(right["terms"].tolist()).astype(np.int64)
            # Doubles hold integers up to 2 ** 53; larger sums stay in integers.
            small = float(np.abs(weights).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * max(1, weights.shape[1]) < 2**52
            postings, wanted = (np.ascontiguousarray(x.astype(np.float64 if small else np.int64)) for x in (weights.T, wanted))
            for own, query, least in zip(right["id"].to_numpy(), wanted, right["least"].to_numpy()):
                at, score = best_in_shard(ids, postings, own, query, k, least if small else -np.inf)
                out.append((np.full(len(at), own), ids[at], score.astype(np.int64)))
        columns = zip(*out) if out else ([], [], [])
        return pd.DataFrame(dict(zip(["query_id", "id", "score"], (np.concatenate([np.array([], np.int64), *c]) for c in columns))))

    return meet


def each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def part(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")


def met(held: DataFrame, posed: DataFrame, k: int) -> DataFrame:
    keys = ["dim", "shard", "block"]
    return held.groupBy(*keys).cogroup(posed.groupBy(*keys)).applyInPandas(meeting(k), "query_id long, id long, score long")


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the k best rows of ``df`` for each row of ``queries``."""
    rows, asked = quantized(df, id_col, vector_col), quantized(queries, id_col, vector_col)
    n, m, cores = rows.count(), asked.count(), df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD_ROWS), min(-(-n // LEAST_ROWS), 3 * cores))
    firsts, blocks = max(1, -(-n // FIRST_ROWS)), max(1, -(-m // BLOCK_ROWS))
    posed = asked.withColumn("block", part(blocks, 2))
    # One of the small shards gives every query a score that its k-th best vector has at least.
    first = rows.where(part(firsts, 3) == 0).withColumns({"shard": F.lit(0), "block": F.lit(0)}).withColumn("block", each(blocks))
    seen = met(first, posed.withColumns({"shard": F.lit(0), "least": F.lit(float("-inf"))}), k)
    nth = seen.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("nth") == k)
    least = nth.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    posed = posed.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = met(rows.withColumn("shard", part(shards, 1)).withColumn("block", each(blocks)), posed.withColumn("shard", each(shards)), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
