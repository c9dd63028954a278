"""Document fingerprints: threshold-scaled sketches, and each document beside the next one.

The sketch of a text keeps every hash of its word shingles below a fixed fraction of the hash range, so it grows
with the text and two sketches estimate how much of one set lies in the other however unequal they are. A text with
fewer than ``LEAST`` such hashes keeps its ``LEAST`` smallest ones, or all that it has: short texts are compared too, those of up to
``LEAST`` shingles exactly. The bound that goes with a sketch says below what it is whole. Two sketches are
compared, and merged, below the smaller of their bounds, where both are whole.

A document and the next one by id meet without a sort of the whole table in one place: sampled ids cut the ids into buckets of
about ``BUCKET_ROWS``, each text moves once, and a bucket also gets the first document of the bucket after it (the last one that of
the first). A task streams through its sorted buckets and holds two texts.

Defined cases: null, empty and wordless texts have an empty sketch; two empty sketches are alike (1), an empty and another
one aren't (0); with fewer words than a shingle the whole sequence is one shingle. Rows that share an id follow each other in the order of
their texts; a single document is its own next one; rows with a null id have no next document, so their edited text is
their own and their likeness to the next is null. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import by_bytes, text_or_empty
from docmill.llm.near_dup import shingles

#: Words of a shingle, the share of hashes that are kept (one of so many), and hashes of a sketch at least.
WIDTH, ONE_OF, LEAST = 5, 16, 64
#: Hashes are below this; the bound of a sketch that holds all of its set is this.
ALL = 1 << 63
#: Rows of a bucket on average, buckets at most, and sampled ids for each.
BUCKET_ROWS, MOST_BUCKETS, SAMPLES = 1024, 100_000, 8
#: Characters of texts whose results are held before they leave a task.
HELD_CHARS = 4 << 20


class Sketch(NamedTuple):
    """Shingles of the text, the bound below which the sketch is whole, and the hashes in order."""

    n_shingles: int
    bound: int
    hashes: np.ndarray

    def text(self) -> str:
        """Bound and hashes, 16 hex digits each."""
        return f"{self.bound:016x}" + self.hashes.astype(">i8").tobytes().hex()


def sketch(text: str, width: int = WIDTH, one_of: int = ONE_OF, least: int = LEAST) -> Sketch:
    items = np.unique(shingles(text, width) >> np.uint64(1)).astype(np.int64)
    bound = ALL // one_of
    kept = int(np.searchsorted(items, bound))
    if kept < least:
        kept, bound = (len(items), ALL) if len(items) <= least else (least, int(items[least]))
    return Sketch(len(items), bound, items[:kept])


def below(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both below the smaller bound."""
    bound = min(a.bound, b.bound)
    return tuple(s.hashes[: np.searchsorted(s.hashes, bound)] if bound < ALL else s.hashes for s in (a, b))


def likeness(a: Sketch, b: Sketch) -> float:
    """The estimated share of common shingles in those of either."""
    x, y = below(a, b)
    if not a.n_shingles and not b.n_shingles:
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def containment(a: Sketch, b: Sketch) -> float:
    """The estimated share of the shingles of ``a`` that ``b`` has."""
    x, y = below(a, b)
    if not a.n_shingles:
        return 1.0
    return len(np.intersect1d(x, y, assume_unique=True)) / max(len(x), 1)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the beginning of the following one."""
    gone = len(text) // 4
    return text[: len(text) - gone] + following[:gone]


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, one_of: int = ONE_OF, least: int = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_shingles, bound, hashes and the columns to ``keep`` of every row; a bound of null stands for a whole set."""
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.lit(0), *keep).alias("kept"), text_or_empty(text_col).alias("text"))

    def work(batches):
        for batch in batches:
            for at, end in by_bytes(batch.column(2), HELD_CHARS):
                part = batch.slice(at, end - at)
                found = [sketch(t.as_py(), width, one_of, least) for t in part.column(2)]
                bounds = [None if s.bound == ALL else s.bound for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.n_shingles for s in found], pa.int64()), pa.array(bounds, pa.int64()), pa.array([s.hashes for s in found], pa.list_(pa.int64()))],
                    ["id", "kept", "n_shingles", "bound", "hashes"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(work, f"id {kinds['id']}, kept {kinds['kept']}, n_shingles long, bound long, hashes array<long>")
    return out.select(F.col("id").alias(id_col), "n_shingles", "bound", "hashes", *(F.col("kept")[c].alias(c) for c in keep))


def bucketed(df: DataFrame, id_col: str, text_col: str, bucket_rows: int) -> DataFrame:
    """id, text, bucket and after: buckets are ranges of ids, each with the rows of the first id of the next one, marked ``after``."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    count = rows.count()
    buckets = min(max(1, -(-count // bucket_rows)), MOST_BUCKETS)
    chance = min(1.0, buckets * SAMPLES / max(count, 1))
    drawn = F.xxhash64("id", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) < F.lit(int(chance * (1 << 52)))
    ids = sorted(r.id for r in rows.where(drawn).select("id").distinct().collect()) if buckets > 1 else []
    bounds = sorted({ids[k * len(ids) // buckets] for k in range(1, buckets)}) if ids else []
    held = rows.sparkSession.sparkContext.broadcast(pd.Index(bounds))

    @F.pandas_udf("int")
    def bucket_of(own: pd.Series) -> pd.Series:
        return pd.Series(held.value.searchsorted(own, side="right") if len(held.value) else np.zeros(len(own)), dtype="int32")

    numbered = rows.withColumn("bucket", bucket_of("id")) if bounds else rows.withColumn("bucket", F.lit(0))
    firsts = sorted((r.bucket, r.id) for r in numbered.groupBy("bucket").agg(F.min("id").alias("id")).collect())  # a row for each bucket
    before = [(own, firsts[at - 1][0]) for at, (_, own) in enumerate(firsts)]
    ahead = rows.sparkSession.createDataFrame(before, f"id {rows.schema['id'].dataType.simpleString()}, before int")
    both = numbered.join(F.broadcast(ahead), "id", "left")
    here = F.struct(F.col("bucket"), F.lit(False).alias("after"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("after"))
    placed = F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there)))
    return both.select("id", "text", placed.alias("at")).select("id", "text", "at.bucket", "at.after")


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"


def described(text: str, own: Sketch, following: tuple[str, Sketch] | None) -> tuple:
    changed = edited(text, following[0]) if following else text
    other = sketch(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    near = (likeness(own, following[1]), containment(own, following[1])) if following else (None, None)
    return len(text), digest, own.text(), other.text(), likeness(own, other), near[0], containment(own, other), near[1]


def beside_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """id, n_chars, the SHA-256 of the edited text, both fingerprints, and likeness and containment of the text's to those of the edited text and of the next document."""
    placed = bucketed(df, id_col, text_col, bucket_rows).repartition("bucket").sortWithinPartitions("bucket", "after", "id", "text")
    kind = placed.schema["id"].dataType.simpleString()

    def batch_of(ids: list, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", *(c.split()[0] for c in RESULT.split(", "))])

    def work(batches):
        ids, out, held, before = [], [], 0, None
        for batch in batches:
            for own, text, bucket, after in zip(*(batch.column(c) for c in range(4))):
                own, text, bucket, after = own.as_py(), text.as_py(), bucket.as_py(), after.as_py()
                if after and before is None:  # further rows of the next bucket's first id
                    continue
                mark = sketch(text)
                if before and before[0] == bucket:
                    ids.append(before[1])
                    out.append(described(before[2], before[3], (text, mark)))
                    held += len(before[2])
                before = None if after else (bucket, own, text, mark)
                if held > HELD_CHARS or len(out) >= 1000:
                    yield batch_of(ids, out, batch.schema.field(0).type)
                    ids, out, held = [], [], 0
            kind_of_id = batch.schema.field(0).type
        if out:
            yield batch_of(ids, out, kind_of_id)

    def alone(batches):
        for batch in batches:
            for at, end in by_bytes(batch.column(1), HELD_CHARS):
                part = batch.slice(at, end - at)
                texts = [t.as_py() for t in part.column(1)]
                yield batch_of([None] * len(texts), [described(t, sketch(t), None) for t in texts], part.schema.field(0).type)

    nameless = df.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = placed.mapInArrow(work, f"id {kind}, {RESULT}").unionByName(nameless.mapInArrow(alone, f"id {kind}, {RESULT}"))
    return out.withColumnRenamed("id", id_col)
