"""Writers: partitioned documents, JSON lines, upserts, deletions, retention and incremental backup.

Parquet has no update: changes are functions from table to table, and the result is written elsewhere or
over the old one in a single job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.reports import last_change, updated


def write_documents(df: DataFrame, path: str, id_col: str = "id") -> None:
    """Gzipped JSON in folders by the first two characters of the id."""
    df.withColumn("id_prefix", F.left(F.col(id_col).cast("string"), F.lit(2))).write.mode("append").partitionBy("id_prefix").option("compression", "gzip").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Changes applied by key; keys that the table lacks are added, each once. Of several changes of one key the last counts (``reports.last_change``)."""
    added = last_change(changes, key, order).join(table, key, "left_anti")
    return updated(table, changes, key, order).unionByName(added.select(*(c for c in added.columns if c in table.columns)), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_cascading(table: DataFrame, keys: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The table and its children, by name, without the deleted keys."""
    gone = keys.select(F.col(key).alias("__gone"))
    return {"": table.join(gone, table[key] == gone["__gone"], "left_anti")} | {name: child.join(gone, child[ref] == gone["__gone"], "left_anti") for name, (child, ref) in children.items()}


def retained(tasks: DataFrame, asof: str, days: int = 30, time_col: str = "completed_at", status: str = "completed") -> DataFrame:
    """Rows that clean-up keeps: not finished with ``status`` before the cutoff."""
    cutoff = F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    old = (F.col(time_col) < cutoff) & (F.col("status") == status)
    return tasks.where(~F.coalesce(old, F.lit(False)))


def summaries(df: DataFrame, source: str, text: str, most: int = 200) -> DataFrame:
    """One row a source: how many items, and their longest text in characters."""
    return df.groupBy(source).agg(F.count("*").alias("items"), F.max(F.length(text)).alias("longest"), F.sum(F.when(F.length(text) > most, 1).otherwise(0)).alias("truncated"))


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """path, md5 and content of files whose path and hash the manifest (path, md5) lacks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("md5"), "content")
    return files.join(manifest.select("path", "md5"), ["path", "md5"], "left_anti")


def back_up(spark: SparkSession, path: str, manifest: DataFrame, target: str) -> DataFrame:
    """Copy files that the manifest (path, md5) lacks to ``target`` as a table of path, md5 and content; the manifest with them, latest hash a path.

    The copy is written first and the manifest is made from what was written, so a job that is repeated copies the same files again.
    """
    changed_files(spark, path, manifest).write.mode("append").parquet(target)
    new = spark.read.parquet(target).select("path", "md5").join(manifest.select("path", "md5"), ["path", "md5"], "left_anti").distinct()
    return manifest.select("path", "md5").join(new.select("path"), "path", "left_anti").unionByName(new)


def files_older_than(files: DataFrame, asof: str, days: int) -> DataFrame:
    """Rows of a file listing that were last changed ``days`` or more before ``asof``: what a clean-up deletes."""
    return files.where(F.col("modificationTime") <= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def with_counters(sources: DataFrame, tasks: DataFrame, key: str = "source_id") -> DataFrame:
    """``sources`` (id, collection_count, success_count, error_count) with the finished tasks (status) of each added to its counters."""
    done = tasks.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("_all"), F.count_if(F.col("status") == "completed").alias("_good"), F.count_if(F.col("status") == "failed").alias("_bad"))
    more = lambda name, by: (F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(by), F.lit(0))).alias(name)
    new = {"collection_count": more("collection_count", "_all"), "success_count": more("success_count", "_good"), "error_count": more("error_count", "_bad")}
    return sources.join(done, "id", "left").select(*(new.get(c, F.col(c)) for c in sources.columns))


def affected(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many rows a change has added, deleted and changed, by key."""
    mark = lambda df: df.select(F.col(key), F.xxhash64(*(F.to_json(F.struct(*df.columns)),)).alias("mark"))
    both = mark(before).withColumnRenamed("mark", "old").join(mark(after).withColumnRenamed("mark", "new"), key, "full")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("deleted"), F.count_if(F.col("old") != F.col("new")).alias("changed"))


UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def migrated(df: DataFrame, schema: str, required: tuple[str, ...] = (), uuid_cols: tuple[str, ...] = (), json_lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows cast to the columns of ``schema`` with ``valid``; missing columns and values that don't fit are null, and required ones make a row invalid.

    ids that are no UUID are repaired to one by their MD5, the same for equal ids in any table; JSON lists are decoded, anything else gives null.
    """
    def value(name: str, kind: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(kind)
        raw = F.col(name).cast("string") if name in (*uuid_cols, *json_lists) else F.col(name)
        if name in json_lists:
            return F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, kind))
        if name in uuid_cols:
            digits = F.md5(raw)
            made = F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
            return F.when(raw.rlike(UUID), F.lower(raw)).otherwise(made)
        return raw.try_cast(kind)

    fields = [(f.name, f.dataType.simpleString()) for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    out = df.select(*(value(name, kind).alias(name) for name, kind in fields))
    valid = F.lit(True)
    for name in required:
        valid = valid & F.col(name).isNotNull()
    return out.withColumn("valid", valid)


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path as it takes it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing ``path``."""
    files, mark = _folder(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def save_state(df: DataFrame, path: str, version: int) -> None:
    """One version of a state table as JSON lines; a whole version is left as it is, so a repeated job changes nothing, and what a broken job has left is written anew."""
    target = f"{path}/version={version}"
    if not _whole(df.sparkSession, target):
        df.write.mode("overwrite").json(target)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest whole version of a state table; no rows if there is none."""
    files, folder = _folder(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    versions = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and _whole(spark, f"{path}/{n}"))
    return spark.read.schema(schema).json(f"{path}/version={versions[-1]}") if versions else spark.createDataFrame([], schema)


def decoded_list(c: str, kind: str = "array<string>") -> Column:
    """A JSON list; anything else, broken text included, gives null."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, kind))
