"""Groups of sorted rows as a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of whole groups of rows sorted by integer keys, with the start of each group and the end of the last.

    Only the last group of a batch is held back for the next one, so memory is bounded by a batch and a group.
    """
    pending = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if pending is not None:
            batch = pa.concat_batches([pending, batch])
        changes = np.zeros(batch.num_rows, bool)
        changes[0] = True
        for key in keys:
            values = batch.column(key).to_numpy()
            changes[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(changes)
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
        pending = batch.slice(starts[-1])
    if pending is not None:
        yield pending, np.array([0, pending.num_rows])
