"""Vectors of whole numbers inside tasks: scaled floors, exact inner products, ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Whole numbers below it are exact in double precision.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1
#: Components are cut to it, so that scaling stays finite.
HUGE = 1e290


def floors(table: pa.Table, d: int, scale: int, column: str = "embedding") -> np.ndarray:
    """Rows of floor(scale * x), in double precision."""
    x = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, d)
    return np.floor(np.clip(x, -HUGE, HUGE) * scale)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are where no sum of their products can reach EXACT, else as Python's whole numbers."""
    most = [float(np.abs(a).max(initial=0)) for a in arrays]
    if arrays[0].shape[1] * max(most[0], 1) * max(most[1], 1) < EXACT:
        return arrays
    return tuple(np.array([int(v) for v in a.ravel()], object).reshape(a.shape) for a in arrays)


def longs(values: list) -> pa.Array:
    """Scores as longs; those beyond are cut to the ends."""
    return pa.array([min(max(int(v), LEAST), MOST) for v in values], pa.int64())


def ids(table: pa.Table, column: str = "vec_id") -> tuple[np.ndarray, np.ndarray]:
    """Ids with nulls as the largest number, and where they are null."""
    own = table.column(column).combine_chunks()
    return own.fill_null(MOST).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
