"""Vectors read from array columns, as rows of one matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(column: str, dim: int) -> Column:
    """True where a vector has `dim` components, none of them null or not finite."""
    value = F.col(column).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(value) == dim) & ~bad, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) doubles of a list column whose values are all whole."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def from_bytes(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    """(rows, dim) of a binary column whose values have `dim` numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def rows_of_bytes(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row of a matrix."""
    size = rows.shape[1] * rows.dtype.itemsize if len(rows) else 0
    data = np.ascontiguousarray(rows).tobytes()
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
