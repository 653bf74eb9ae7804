"""Python over columns, a slice of a batch at a time.

A batch stays as Arrow has it; a worker holds the objects of one slice, whatever the size of
the batch or of the table, and gives memory back when its partition is done.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a slice, at most, and bytes of a slice of several rows.
SLICE, SLICE_BYTES = 256, 1 << 20


def sliced(batch: pa.RecordBatch | pa.Array) -> Iterator:
    """The slices of a batch or an array, in order; a row of more bytes is a slice of its own."""
    n = len(batch)
    rows = max(1, min(SLICE, n * SLICE_BYTES // max(1, batch.nbytes)))
    for k in range(0, n, rows):
        yield batch.slice(k, rows)


def given_back() -> None:
    """What Arrow and the C library hold of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def column_of(values: Callable[[list], list], kind: str, arrow: pa.DataType) -> Callable[..., Column]:
    """A function on one column: ``values`` maps the Python values of a slice to as many of type
    ``kind``, which is ``arrow`` in Arrow."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for array in arrays:
                for part in sliced(array):
                    yield pa.array(values(part.to_pylist()), type=arrow)
        finally:
            given_back()

    return lambda c: F.arrow_udf(run, kind)(c)  # made when a session is there
