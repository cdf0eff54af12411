"""Vectors as whole numbers, compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger whole components are an error: their squared distances would not fit into 64 bits.
LIMIT = 1 << 40


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds only finite numbers; an empty one does."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component, as long."""

    def one(v: Column) -> Column:
        wide = v.cast("double") * scale
        return F.when(F.abs(wide) < LIMIT, F.floor(wide)).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}")))

    return F.transform(vector, one)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def comfortable(*arrays: np.ndarray) -> list[np.ndarray]:
    """The same whole numbers in doubles, where every sum of products that a comparison makes is exact in these; else in whole numbers of any size."""
    reach = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    width = max(a.shape[-1] for a in arrays)
    kind = np.float64 if 8 * reach * reach * max(width, 1) < 1 << 53 else object
    return [a.astype(kind) for a in arrays]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c, exactly; both from ``comfortable``."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def means(sums: list[int], n: int, before: list[int]) -> list[int]:
    """The floor of each sum over n; what was before, if n is 0."""
    return [s // n for s in sums] if n else before
