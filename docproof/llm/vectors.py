"""Vector columns as numpy blocks."""

import numpy as np
from pyspark.sql import Column, functions as F


def is_finite_vector(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unpack(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(rows, -1)
