"""Vectors out of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rows_by_length(column: pa.Array):
    """(rows, matrix) for each vector length in column, in double precision; null components: NaN. Null and empty vectors are left out."""
    column = column.cast(pa.list_(pa.float64()))
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.values, float("nan")).to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(offsets), 0)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def stacked(blobs) -> np.ndarray:
    """The matrix of equally long vectors kept as bytes."""
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
