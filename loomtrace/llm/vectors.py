"""Vectors as exact integers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Largest integer of a component: squares, sums over 64 components and four times these fit 64 bits.
LIMIT = 1 << 25


def integers(column: pa.ListArray, scale: int = 64) -> tuple[pa.ListArray, np.ndarray]:
    """floor(scale * c) of each component as a 32-bit integer, and which rows count: those that are
    not null and hold no null, NaN or infinity. Integers beyond +-LIMIT are cut to it."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.isfinite(values)
    bad_before = np.append(0, np.cumsum(~good))
    offsets = offsets - offsets[0]
    whole = bad_before[offsets[1:]] == bad_before[offsets[:-1]]
    with np.errstate(over="ignore"):
        whole_numbers = np.clip(np.floor(np.where(good, values, 0.0) * scale), -LIMIT, LIMIT).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole_numbers)), whole & column.is_valid().to_numpy(zero_copy_only=False)


def matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Rows of equal length as 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def listed(rows: np.ndarray) -> pa.ListArray:
    """The reverse of ``matrix``."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(rows.reshape(-1).astype(np.int32)))
