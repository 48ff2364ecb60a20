"""Vectors in Arrow batches: which take part, and exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, some component not zero, all components present and finite."""
    return F.coalesce(
        v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length of usable vectors (ties: the longer one); 0 without any."""
    rows = vectors.filter(usable(F.col(column))).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows[0]["n"] if rows else 0


def matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix of doubles (no nulls, equal lengths)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``: equal rows give equal results,
    wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
