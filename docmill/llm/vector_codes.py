"""Vector code compression: product quantisation in integers, the same to the last bit wherever it runs.

Components become integers, vectors are cut into equal parts, and each part is coded by the index of the nearest entry of
its codebook. Codebooks have a fixed size (parts x entries x width), are broadcast, and start as the
parts of the vectors with the smallest ids. In each round Arrow batches compute the squared distances of all their
parts by norm expansion, |x|^2 - 2 x.c + |c|^2, as exact products of int64 matrices, and take the first least one. A task
adds up what it has given to each entry, a grouped shuffle merges these sums, at most one row for each entry and
task, and the driver gets one row for each entry. So a round moves nothing that grows with the vectors.

Defined cases: vectors that are null or hold null or non-finite components drop out, and so do those of another dimension than the
vector of the smallest id; components beyond 2 ** 27 after scaling are set to that bound, so no square or sum leaves int64
(up to 512 components a part); a dimension that the parts don't divide is filled with zeros; null ids are coded but give
no first entry; rows that repeat an id are separate vectors, in the order of their components; with fewer vectors than
entries a codebook is that much smaller; an empty table has an empty result and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize

#: What components are limited to, and vectors whose distances are held at a time.
MOST, SLICE = 1 << 27, 4096


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, index and place, and what made integers of the components."""

    entries: np.ndarray
    scale: int
    dim: int

    def digest(self) -> str:
        """SHA-256 of the decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, vector of floor(scale * x) and the columns to ``keep`` as one struct, of the vectors that take part."""
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(value, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * scale))).cast("int"))
    rows = df.where(F.col(vector_col).isNotNull() & sound)
    return rows.select(F.col(id_col).alias("id"), whole.alias("vector"), F.struct(F.lit(0), *keep).alias("kept"))


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Vectors by row, part and place, filled with zeros at the end."""
    width = -(-vectors.shape[1] // parts)
    return np.pad(vectors, ((0, 0), (0, width * parts - vectors.shape[1]))).reshape(len(vectors), parts, width)


def slices(column: pa.Array, dim: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where a slice of a column of vectors begins, and its int64 parts."""
    for at in range(0, len(column), SLICE):
        held = column.slice(at, SLICE)
        yield at, cut(held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(held), dim), parts)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each part, and its squared distance."""
    codes, errors = np.zeros(parts.shape[:2], np.int64), np.zeros(parts.shape[:2], np.int64)
    for p, own in enumerate(entries):
        x = np.ascontiguousarray(parts[:, p])
        far = (own * own).sum(1)[None, :] - 2 * (x @ own.T)
        codes[:, p] = far.argmin(1)
        errors[:, p] = far[np.arange(len(x)), codes[:, p]] + (x * x).sum(1)
    return codes, errors


def assigned_sums(rows: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n and sums of what a task has given to each entry."""
    held, dim = rows.sparkSession.sparkContext.broadcast(books.entries), books.dim

    def work(batches):
        entries = held.value
        n, sums = np.zeros(entries.shape[:2], np.int64), np.zeros(entries.shape, np.int64)
        for batch in batches:
            for _, parts in slices(batch.column(0), dim, len(entries)):
                codes, _ = nearest(parts, entries)
                for p in range(len(entries)):
                    n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
                    np.add.at(sums[p], codes[:, p], parts[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    return rows.select("vector").mapInArrow(work, "part int, entry int, n long, sums array<long>")


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of the vectors of ``integers``: the parts of the smallest ids, moved to the floor of their means ``rounds`` times; unused entries stay."""
    ordered = rows.where("id IS NOT NULL").orderBy("id", "vector").select("vector")
    one = ordered.first()
    dim = len(one.vector) if one else 0
    rows = rows.where(F.size("vector") == dim)
    first = ordered.where(F.size("vector") == dim).limit(entries).collect() if one else []
    start = np.array([r.vector for r in first], np.int64).reshape(len(first), dim)
    books = np.ascontiguousarray(cut(start, parts).transpose(1, 0, 2))
    width = books.shape[2]
    for _ in range(rounds if start.size else 0):
        total = assigned_sums(rows, Codebooks(books, scale, dim)).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)))
        books = books.copy()
        for r in total.collect():  # one row for each entry
            books[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
    return Codebooks(books, scale, dim)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, codes (an index for each part), error (squared distances in integers) and the kept columns of the vectors of ``integers``."""
    held, dim = rows.sparkSession.sparkContext.broadcast(books.entries), books.dim

    def work(batches):
        for batch in batches:
            for at, parts in slices(batch.column(1), dim, len(held.value)):
                codes, errors = nearest(parts, held.value)
                own = batch.slice(at, len(parts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(errors.sum(1))], ["id", "kept", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    usable = rows.where((F.size("vector") == dim) & F.lit(books.entries.shape[1] > 0))
    coded = usable.select("id", "vector", "kept").mapInArrow(work, f"id {kinds['id']}, kept {kinds['kept']}, codes array<int>, error long")
    return coded.select("id", "codes", "error", *(F.col("kept")[c].alias(c) for c in rows.schema["kept"].dataType.names[1:]))


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``vector``, what its codes stand for, in the scale of the original."""
    held, scale, dim = coded.sparkSession.sparkContext.broadcast(books.entries), books.scale, books.dim

    @F.pandas_udf("array<double>")
    def vector(codes):
        entries = held.value
        return codes.map(lambda c: entries[np.arange(len(entries)), c].ravel()[:dim] / scale)

    return coded.withColumn("vector", vector("codes"))


def hex_code(codes: str = "codes") -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def with_group_error(coded: DataFrame, by: str) -> DataFrame:
    """``coded`` with ``group_error``, the error summed over the rows of equal ``by``, nulls together."""
    coded = materialize(coded, "coded")
    sums = coded.groupBy(by).agg(F.sum("error").alias("group_error")).withColumnRenamed(by, "_by")
    return coded.join(sums, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
