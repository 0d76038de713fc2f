"""Vectors of texts without a model: signed feature hashing."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, tokens
from ..workers import ship
from .textindex import run_starts, words_of


def hashed_vectors(rows: DataFrame, keys: list[str], text: Column, dim: int = 64, least: int = 3) -> DataFrame:
    """keys and embedding, a unit vector of ``dim`` (256 at most) doubles: each token of ``least`` letters or more adds 1 or -1 in one place; the first byte of its MD5 says where, the bit after it which.

    Texts without such tokens, and those whose tokens cancel out, have no row; rows that share their keys are one text.
    """
    return hashed_words(rows, keys, F.array_join(tokens(fold(text)), " "), dim, least)


def hashed_words(rows: DataFrame, keys: list[str], words: Column, dim: int = 64, least: int = 3) -> DataFrame:
    """``hashed_vectors`` of texts whose folded tokens are at hand, in one string with spaces between."""
    ship(rows.sparkSession)

    def listed(sums):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                code, of = words_of(batch.column(batch.num_columns - 1))
                digests = [md5(w.encode()).digest() if len(w) >= least else None for w in code.dictionary.to_pylist()]
                place = np.array([d[0] % dim if d else 0 for d in digests], dtype=np.int64)
                sign = np.array([(1 if d[1] < 128 else -1) if d else 0 for d in digests], dtype=np.int64)
                at = code.indices.to_numpy()
                sums = np.bincount(of * dim + place[at], weights=sign[at], minlength=batch.num_rows * dim).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed(sums.reshape(-1, dim))], names=[*batch.schema.names[:-1], "v"])

    def unit(named, sums):
        size = np.sqrt((sums * sums).sum(axis=1).astype(np.float64))
        some = np.flatnonzero(size > 0)
        named = named.take(pa.array(some)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(named.column(i).combine_chunks() for i in range(len(keys))), listed(sums[some] / size[some, None])], names=[*named.column_names, "embedding"])

    def add(batches):
        """Sorted rows as one for the same keys; a batch's last one waits for the next batch."""
        held = None
        for batch in batches:
            if batch.num_rows:
                named, sums = pa.Table.from_batches([batch]).select(range(len(keys))), batch.column(len(keys)).flatten().to_numpy().reshape(-1, dim)
                if held is not None:
                    named, sums = pa.concat_tables([held[0], named]), np.concatenate([held[1], sums])
                first = run_starts(named, named.column_names)
                named, sums = named.take(pa.array(first)), np.add.reduceat(sums, first, axis=0)
                held = named.slice(len(first) - 1), sums[-1:]
                yield unit(named.slice(0, len(first) - 1), sums[:-1])
        if held is not None:
            yield unit(*held)

    texts = rows.select(*keys, words.alias("_words"))
    made = lambda name, kind: T.StructType([*texts.schema.fields[:-1], T.StructField(name, T.ArrayType(kind))])
    # A row's tokens are summed where they are and all its places shuffled once, as one row. 64 sums of Spark's own are more code than the JVM compiles.
    return texts.mapInArrow(count, made("v", T.LongType())).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, made("embedding", T.DoubleType()))
