"""Tables that a job writes once in the folder that driver and executors share, so that lineage ends there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is unset a temporary folder is made, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docmill-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def tables_dir(spark: SparkSession) -> str:
    """Where this application writes its tables."""
    return f"{shared_dir(spark).rstrip('/')}/docmill-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application has written, once no result needs them any more."""
    delete(spark, tables_dir(spark))


def discard(df: DataFrame) -> None:
    """Delete a table of this application that nothing reads any more."""
    base = tables_dir(df.sparkSession).rsplit("/", 1)[1]
    for folder in {m[0] for f in df.inputFiles() if (m := re.match(f".*/{base}/[^/]+", f))}:
        delete(df.sparkSession, folder)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What is run within deletes its shuffle files when it is done; else they stay until the driver's garbage collector finds that nothing refers to them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def in_folders(df: DataFrame, name: str, by: str) -> DataFrame:
    """As ``materialize``, with a folder for each value of the column ``by``: a filter on it reads those folders only."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}/{name}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage and shuffle files end here."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}/{name}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
