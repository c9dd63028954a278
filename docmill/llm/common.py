"""Written tables and small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.tables import clear, materialize, shared_dir, tables_dir

__all__ = ["SLICE_BYTES", "SLICE_ROWS", "by_bytes", "by_size", "clear", "materialize", "shared_dir", "sliced", "tables_dir", "text_or_empty"]

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 500
#: Bytes of the texts or sets of such a part.
SLICE_BYTES = 8 << 20


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def by_size(texts: list[str], most: int) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each; a longer text is a range of its own."""
    ranges, begin, chars = [], 0, 0
    for at, text in enumerate(texts):
        if at > begin and chars + len(text) > most:
            ranges.append((begin, at))
            begin, chars = at, 0
        chars += len(text)
    return [*ranges, (begin, len(texts))] if texts else []


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that a task's Python objects stay small beside it."""
    return (batch.slice(at, SLICE_ROWS) for at in range(0, batch.num_rows, SLICE_ROWS))


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of strings or binaries of about ``most`` bytes each; a longer one is a range of its own, so what a task makes of them stays small."""
    begin, held = 0, 0
    for at, size in enumerate(pc.binary_length(column).to_pylist()):
        if at > begin and (held + (size or 0) > most or at - begin >= SLICE_ROWS):
            yield begin, at
            begin, held = at, 0
        held += size or 0
    if len(column):
        yield begin, len(column)
