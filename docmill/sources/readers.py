"""Readers: documents as JSON, pages as files, feeds, logs, caches; paths of any Hadoop file system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.feeds import entries
from docmill.functions.html import Selectors, extracted


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, compressed or not, in any depth of folders."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)


def stored_ids(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """ids of stored documents, from the names of their files alone."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(path).select("path")
    ids = names.select(F.regexp_extract("path", r"([^/]+?)\.json(\.gz)?$", 1).alias("id"))
    return ids.where(F.startswith("id", F.lit(prefix)))


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, length and modification time of files, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "length", "modificationTime")


def web_pages(spark: SparkSession, path: str, profile: str | Selectors = "default") -> DataFrame:
    """Pages in files, one a file, with their extracted parts."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    pages = files.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    return pages.withColumn("parts", extracted("html", "url", profile))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.text(path, wholetext=True, recursiveFileLookup=True), "value")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"rss": feed_entries, "rss_feed": feed_entries, "atom": feed_entries, "web": web_pages, "html": web_pages}


def reader_of(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    if kind not in READERS:
        raise ValueError(f"no reader for sources of kind {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind]


#: A log line: time, then the level as a word of its own somewhere before the message.
LOG_LINE = r"^(\S+[ T]\S+?)\s.*?\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b\W*(.*)$"


def log_lines(spark: SparkSession, path: str, level: str | None = None, last: int = 50) -> DataFrame:
    """time, level, message and value of the last lines of logs by their leading timestamp, of one level if given. Lines of another form have no level."""
    part = lambda i: F.nullif(F.regexp_extract("value", LOG_LINE, i), F.lit(""))
    lines = spark.read.text(path).select(part(1).alias("time"), part(2).alias("level"), part(3).alias("message"), "value")
    lines = lines.where(F.col("level") == level.upper()) if level else lines
    return lines.orderBy(F.desc(F.coalesce("time", "value")), F.desc("value")).limit(last)


def cache_key(url: str = "url", method: str = "method") -> Column:
    return F.md5(F.concat_ws(":", url, method))


def cached(requests: DataFrame, cache: DataFrame, asof: str) -> DataFrame:
    """Requests (url, method) with ``response`` and ``hit`` from cache rows (key, response, expires_at) that are still valid at ``asof``."""
    valid = unexpired_cache(cache, asof).select("key", "response")
    return requests.withColumn("key", cache_key()).join(valid, "key", "left").withColumn("hit", F.col("response").isNotNull())


def with_responses(cache: DataFrame, responses: DataFrame, asof: str, ttl_seconds: int = 3600) -> DataFrame:
    """The cache with new responses (url, method, response), which replace those of the same key and live for ``ttl_seconds``."""
    expires = F.lit(asof).cast("timestamp") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    new = responses.select(cache_key().alias("key"), "response", expires.alias("expires_at"))
    return cache.select("key", "response", "expires_at").join(new.select("key"), "key", "left_anti").unionByName(new)


def unexpired_cache(cache: DataFrame, asof: str) -> DataFrame:
    """The cache without what has expired at ``asof``."""
    return cache.where(F.col("expires_at") >= F.lit(asof).cast("timestamp"))


def item_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, source_name, items, collected_at and url of files that each hold a result with a list of items, latest first."""
    schema = "source_name STRING, url STRING, collected_at STRING, items ARRAY<STRING>"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    found = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), "source_name", F.coalesce(F.size("items"), F.lit(0)).alias("items"), "collected_at", "url")
    return found.orderBy(F.desc("collected_at"), "path")


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 16, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options).load()
