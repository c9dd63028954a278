"""Substring search that reads only files which can hold the text: a trigram signature for each file.

The signature of a file is a bit for the hash of each three characters in a row that any of its rows holds, in lower case. A file lacks a text if it
lacks one of its trigrams, so the files left are a superset and the search itself stays exact. Signatures are made in
Arrow batches, one for each file and task, and merged by ``bit_or``; they take ``BITS`` / 8 bytes a file at most, whatever the file's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.reports import search

#: Bits of a signature.
BITS = 1 << 18


def trigram_bits(text: str) -> np.ndarray:
    """The distinct bits of the trigrams of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1]) * np.uint64(0x85EBCA77) ^ codes[2:]
    mixed = (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.unique(mixed % np.uint64(BITS)).astype(np.int64)


def index_of(files: DataFrame, *columns: str) -> DataFrame:
    """file, word and bits: the signature of each file that ``files``, a table just read, comes from. Null columns count as empty; a file without rows isn't in it."""
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.lower(F.concat_ws(" ", *columns)).alias("text"))

    def work(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for file, text in zip(batch.column(0), batch.column(1)):
                bits = held.setdefault(file.as_py(), np.zeros(BITS // 64, np.uint64))
                at = trigram_bits(text.as_py())
                np.bitwise_or.at(bits, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        for file, bits in held.items():
            words = np.flatnonzero(bits) if bits.any() else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(words)), pa.array(words, pa.int32()), pa.array(bits[words].astype(np.int64))], ["file", "word", "bits"])

    each = rows.mapInArrow(work, "file string, word int, bits long")
    return each.groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))


def candidate_files(index: DataFrame, query: str) -> DataFrame:
    """The files that can hold ``query``. A query of fewer than three characters can be in any."""
    needed: dict[int, int] = {}
    for at in trigram_bits(query.lower()).tolist():
        needed[at // 64] = needed.get(at // 64, 0) | 1 << at % 64
    if not needed:
        return index.select("file").distinct()
    spark = index.sparkSession
    signed = [(word, bits - (1 << 64) if bits >> 63 else bits) for word, bits in needed.items()]
    wanted = F.broadcast(spark.createDataFrame(signed, "word int, need long"))  # a row a trigram of the query at most
    held = index.join(wanted, "word").where(F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
    return held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(needed)).select("file")


def indexed_search(spark: SparkSession, path: str, index: DataFrame, query: str, *columns: str) -> DataFrame:
    """As ``reports.search`` over the Parquet table at ``path``, reading only the files that can hold the query. The names of these files go through the driver."""
    names = [r.file for r in candidate_files(index, query).collect()]
    table = spark.read.parquet(path)
    if not names:
        return search(table.limit(0), query, *columns)
    return search(spark.read.schema(table.schema).option("basePath", path).parquet(*names), query, *columns)
