"""Arrow vectors as NumPy matrices."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double): not null, of length dim, all components finite, not all zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    full = np.array(col.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pick = np.flatnonzero(full & (size == dim))
    if not len(pick) or not dim:
        return pick[:0], np.zeros((0, max(dim, 1)))
    col = col.take(pa.array(pick))
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pick), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return pick[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y, pair by pair; equal rows give equal results wherever they stand."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, those with the smallest hash of vec_id; its width is the commonest among them."""
    rows = vectors.where("embedding is not null and size(embedding) > 0").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").toArrow()
    col = rows.column(0).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    sizes = Counter(col.value_lengths().to_pylist())
    dim = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    x = matrix(col, dim)[1]
    return unit(x) if len(x) else np.zeros((0, dim))
