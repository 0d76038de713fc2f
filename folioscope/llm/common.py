"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow text batches, word hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import checkpoint_folder, ship

#: Bytes of text that one NumPy step handles at a time; bounds a Python worker's memory.
STEP_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Rows in an Arrow batch on its way to a Python worker; whole texts and sets travel in them.
BATCH_ROWS = 1000


_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BEFORE: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ships this package to the Python workers, once a context, and lowers the session's Arrow batches to BATCH_ROWS rows, which bounds what executors and their workers hold. Results are lazy, so the setting stays until ``release``."""
    ship(spark)
    now = spark.conf.get(_ARROW)
    if not 0 < int(now) <= BATCH_ROWS:
        _BEFORE[_ARROW] = now
        spark.conf.set(_ARROW, str(BATCH_ROWS))


class Scratch:
    """Tables in the shared folder that cut lineage and survive a lost executor.

    An operator drops what it no longer needs as it goes. What its result still reads stays until ``release``, or until
    the ``owned`` block ends in which the operator was called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.tables = spark, f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", set()
        prepare(spark)
        _LIVE.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str) -> str:
        """Writes ``df`` in buckets sorted by the keys and returns the table's name; joins on the keys then leave its rows where they are."""
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", self.path(name)).saveAsTable(table)
        self.tables.add(table)
        return table

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.remove(df._scratch_path)

    def drop_table(self, table: str) -> None:
        place = self.spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table if exists {table}")
        self.remove(place)
        self.tables.discard(table)

    def clear(self) -> None:
        """Drops everything, with what the operator's result reads."""
        for table in list(self.tables):
            self.drop_table(table)
        self.remove(self.base)
        _LIVE.remove(self)

    def sweep(self) -> None:
        """Lets the driver forget the shuffles that no frame needs any more, so that their files go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_LIVE: list[Scratch] = []


def release(spark: SparkSession) -> None:
    """Drops every scratch table of this session and restores its Arrow batches; frames that operators returned can't be read after that."""
    for scratch in list(_LIVE):
        scratch.clear()
    if _ARROW in _BEFORE:
        spark.conf.set(_ARROW, _BEFORE.pop(_ARROW))


@contextmanager
def owned() -> Iterator[None]:
    """Drops, at its end, the scratch tables of the operators that were called inside: for callers that have written the results by then."""
    before = set(map(id, _LIVE))
    try:
        yield
    finally:
        for scratch in [x for x in _LIVE if id(x) not in before]:
            scratch.clear()


#: A key that has more than one in so many of all rows is heavy; there can't be more heavy keys than this.
HEAVY = 1000


def join_by(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows inner-joined to ``table``, which has each key once and in ``weight`` how many of the ``total`` rows have it.

    The heavy keys, HEAVY at most, are broadcast, so that none of them gathers its rows in one task; the others are shuffled.
    """
    heavy = F.col(weight) * HEAVY > total
    hot = F.broadcast(table.where(heavy))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(~heavy), key)
    return rows.join(hot, key).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def text_steps(batches: Iterator[pa.RecordBatch], text: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``step`` bytes of text, or one row: (slice, bytes, offsets). Null texts count as empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        col = batch.column(at)
        if col.null_count:
            col = col.fill_null("")
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        n = len(col)
        if not n:
            continue
        _, off, data = col.buffers()
        offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, side="right")) - 1)
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different value, which of them each value is)."""
    order = np.argsort(x)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    which = np.empty(len(x), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and where each text's words begin: words ptr[i]:ptr[i+1]."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SPACE[buf]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    edge[first] = word[first]
    starts = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    edge[last] = word[last]
    return starts, np.flatnonzero(edge) + 1, np.searchsorted(starts, offs)


_POWER: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWER[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[:1] = 1
            _POWER[k] = np.multiply.accumulate(table)
    return _POWER


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[_SPACE] = 0
    return values[_LOWER] if lower else values


_VALUES = {True: _byte_values(True), False: _byte_values(False)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit polynomial hash of each word, with A-Z lower-cased if ``lower``."""
    out = np.empty(len(starts), dtype=np.uint64)
    values, i, n = _VALUES[lower], 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(max(hi - lo, 1 << 16))
        at = starts[i:j] - lo
        out[i:j] = np.add.reduceat(values[buf[lo:hi]] * power[: hi - lo], at) * inverse[at]
        i = j
    return mix(out)
