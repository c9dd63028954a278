"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, secret redaction, packing.

Each stage takes the documents that the one before has kept and is written as Parquet before the next
one reads it. All but the last return the columns of ``documents``; the last returns packed pieces.

Defined cases, of every stage: an empty table gives an empty one; columns beyond those of ``documents`` stay, also where their names are
ones that operators use inside; rows that repeat an id are separate rows, and go or stay together where a decision is
about an id. What null, empty and very long texts come to is said at each stage; none is cut before packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, line_dedup, near_dup, packing, quality, secrets
from docmill.llm.common import tables_dir
from docmill.llm.queries import vocabulary
from docmill.tables import delete


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars``, where the documents have it, follows the text."""
    changed = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return changed.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or the verdict of their host reject go: null and empty texts have no words and go. A null source is a host of its own."""
    return quality.kept_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, and documents that lost a line and have no word left; wordless and null texts that lost nothing stay. Repeated rows of one id and text count as one document and all keep its lines; null ids come first in the order. ``n_chars`` follows the text."""
    return _with_length(line_dedup.deduplicate(docs), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays; texts without words and rows with a null id are linked with nothing and stay."""
    return near_dup.kept_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported secrets are replaced by a mark, whatever they stand in; null texts stay null. ``n_chars`` follows the text."""
    return _with_length(secrets.redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty text is one piece with the end token alone, a longer text is cut into pieces."""
    return packing.pack(docs, bpe.tokenizer_of_file(vocabulary("byte_bpe_50k.json")), 2048, 0)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer, so the rows of the pipeline have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{tables_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:  # the result reads the last table only
            delete(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
