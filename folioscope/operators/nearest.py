"""The nearest vectors of a batch of questions by comparing all: tiles of questions and vectors as matrices, so neither side is whole in a task and no pair is a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ship

#: Vectors and questions of a tile, about; and how many scores are held at once.
ROWS, ASKED, CELLS = 16_384, 8_192, 1 << 22


def _matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double, their lengths); a vector that is null or holds a null has the length -1. Shorter vectors are filled up with zeros."""
    col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    row = np.repeat(np.arange(len(col)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = np.zeros((len(col), max(int(sizes.max(initial=0)), 1)))
    x[row, place] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    usable = np.array(col.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    usable[row[np.array(flat.is_null().to_numpy(zero_copy_only=False), dtype=bool)]] = False
    return x, np.where(usable, sizes, -1)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    y = np.abs(x) * 1e6
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 1e6, x)


def _best(some: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, vector, score): the k best of each question's scores, ties to the smaller doc_id. Minus infinity stands for null here and comes last, infinity for NaN, which comes first."""
    (a, la), (b, lb) = _matrix(some.column("asked")), _matrix(rows.column("embedding"))
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    na, nb = norm(a), norm(b)
    step = max(1, CELLS // max(len(b), 1))
    found = []
    with np.errstate(all="ignore"):
        for lo in range(0, len(a), step):
            hi = min(lo + step, len(a))
            size = na[lo:hi, None] * nb[None]
            score = _rounded(a[lo:hi] @ b.T / size)
            score[np.isnan(score)] = np.inf
            score[(la[lo:hi, None] != lb[None]) | (la[lo:hi, None] < 0) | (size <= 0)] = -np.inf
            # Columns are in the order of doc_id, so of equal scores the first are taken.
            if score.shape[1] > k:
                least = np.partition(score, -k, axis=1)[:, -k][:, None]
                over, tie = score > least, score == least
                keep = over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(axis=1)[:, None]))
            else:
                keep = np.ones(score.shape, dtype=bool)
            i, j = np.nonzero(keep)
            found.append((i + lo, j, score[i, j]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _compare(some: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    i = j = np.zeros(0, np.int64)
    score = np.zeros(0)
    if some.num_rows and rows.num_rows:
        rows = rows.sort_by("doc_id")
        i, j, score = _best(some, rows, k)
    value = pa.array(np.where(score == np.inf, np.nan, score), mask=score == -np.inf)
    return pa.table([some.column("qid").take(pa.array(i)), rows.column("doc_id").take(pa.array(j)), value], names=["qid", "doc_id", "score"])


def candidates(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score): of the vectors (doc_id, embedding), each question's (qid, asked) k best of every tile by cosine to six digits, ties to the smaller doc_id: what its k best of all are among. A score is null where ``functions.vector.cosine`` is; such rows come last.

    Two numbers, how many rows each side has, reach the driver; tiles grow in number with them and stay of one size.
    """
    ship(vectors.sparkSession)
    many = lambda df, n: max(1, -(-df.count() // n))
    nv, nq = many(vectors, ROWS), many(asked, ASKED)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("qid", F.col("asked").cast("array<double>").alias("asked"), place("qid", nq).alias("qb")).select("*", every(nv).alias("vb"))
    right = vectors.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), place("doc_id", nv).alias("vb")).select("*", every(nq).alias("qb"))
    schema = f"qid {dict(asked.dtypes)['qid']}, doc_id {dict(vectors.dtypes)['doc_id']}, score double"
    return left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(lambda a, b: _compare(a, b, k), schema)
