"""Embedding columns as numpy matrices."""

from __future__ import annotations

import numpy as np


def matrix_rows(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values as double, offsets, usable) of an Arrow list column; a row is
    usable if neither it nor a component is null and all components are finite."""
    import pyarrow as pa
    import pyarrow.compute as pc
    n = len(col)
    valid = np.asarray(pc.is_valid(col).to_numpy(zero_copy_only=False), bool)
    off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
    flat = col.flatten()
    values = pc.fill_null(pc.cast(flat, pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    off = off.astype(np.int64)
    return values, off, valid & (bad[off[1:]] == bad[off[:-1]]) if n else valid
