"""Arrow batches of bounded bytes, so that what a task holds does not depend on the rows of a batch or of the table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of pixels or tokens that kernels take at a time; they hold several times as much in doubles.
PIECE = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: int, each: int = 1, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of batches, of at least one row, whose values of one column, bytes or lists, are of `most` bytes at most.

    A number of a list counts as eight bytes, and a row as `each` bytes at least: what it becomes, if that is more.
    """
    for batch in batches:
        values = batch.column(column)
        binary = pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type)
        length = pc.binary_length(values) if binary else pc.multiply(pc.list_value_length(values), 8)
        ends = np.cumsum(np.maximum(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), each))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def commas(numbers: pa.ListArray) -> pa.Array:
    """Each list of whole numbers as text, joined by commas; no list or number is null."""
    ends = np.cumsum(pc.list_value_length(numbers).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, numbers.flatten().cast(pa.string())), ",")


def stacked(batch: pa.RecordBatch, column: int, *shape: int) -> np.ndarray:
    """uint8[n, *shape] of a column of equally long bytes."""
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(batch.num_rows, *shape)
