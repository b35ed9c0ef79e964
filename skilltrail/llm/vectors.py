"""Vector columns as integer matrices, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components beyond these are set to them, so that no sum below leaves 64 bits.
LARGEST = 1 << 27
#: Components handled at once.
BLOCK_CELLS = 1 << 18


def whole(vector: Column) -> Column:
    """Vectors that are not null or empty and hold neither null nor non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows with a whole vector of the table's length, and that length (0 without rows).

    The length is that of the row with the smallest key (nulls last, then by the vector); rows
    of another length cannot be compared with it and are left out like broken ones.
    """
    rows = vectors.where(whole(F.col(vector)))
    first = rows.orderBy(F.asc_nulls_last(key), F.size(vector), vector).select(F.size(vector).alias("n")).first()
    if first is None:
        return rows, 0
    return rows.where(F.size(vector) == first["n"]), first["n"]


def matrices(
    batches: Iterator[pa.RecordBatch], dims: int, scale: int, offset: int = 0, cells: int = BLOCK_CELLS
) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Blocks of at most `cells` components: the other columns, and floor(scale * c) + offset.

    The first column holds the vectors, already cut down to usable ones.
    """
    step = max(1, cells // max(1, dims))
    for batch in batches:
        for start in range(0, len(batch), step):
            part = batch.slice(start, step)
            flat = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            grid = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64) + offset
            yield part.columns[1:], grid.reshape(len(part), dims)
