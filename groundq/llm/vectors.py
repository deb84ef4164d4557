"""Vectors in batches, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix in double precision) of the vectors that are neither null nor empty and hold only finite components, by length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = column.flatten().to_numpy(zero_copy_only=False).astype("f8")  # null components become nan
    lengths = np.array(column.value_lengths().fill_null(0), dtype="i8")
    starts = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(lists))])
    good = np.flatnonzero((lengths > 0) & (bad[starts + lengths] == bad[starts]))
    for width in np.unique(lengths[good]):
        own = good[lengths[good] == width]
        yield own, lists[starts[own][:, None] + np.arange(width)]


def common_length(table: DataFrame, n: str) -> int:
    """The most frequent value of n; of equally frequent ones the smallest, 0 for an empty table."""
    found = table.groupBy(n).agg(F.count("*").alias("times")).orderBy(F.desc("times"), n).first()
    return int(found[n]) if found else 0
