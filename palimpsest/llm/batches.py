"""Python steps over Arrow batches whose memory follows a bound in bytes, not a number of rows.

Spark hands a Python worker batches of up to 10,000 rows, whatever their size. `in_slices` cuts each at `SLICE_BYTES` of
one column before it becomes Python objects (a row that is larger is a slice of its own), and gives unused memory back to
the system when the task's rows have ended: workers live on between tasks and stages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the sized column that are Python objects at once.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that a slice of several rows holds at most `most` bytes of a text or binary column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    if not len(ends) or ends[-1] <= most:
        yield batch
        return
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries give it back by themselves
        return


def in_slices(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], column: str | int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`step` for mapInArrow, over slices of the batches, with `release` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(part for batch in batches for part in slices(batch, column))
        finally:
            release()

    return run
