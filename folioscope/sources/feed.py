"""A feed of pages as a Spark data source: records in ascending order of a key, a page at a time, read in parallel and as a stream.

A page is a file of JSON lines whose name tells the keys of its first and last record, so that a reader knows which pages
follow a key without opening any. A batch reads the pages behind ``after`` in as many partitions as there are pages. A
stream's offset is the key up to which it has read, so it goes on in the middle of the feed after a restart.

    spark.dataSource.register(PagedFeed)
    spark.read.format("paged_feed").option("ddl", "page_id long, url string").option("key", "page_id").load(folder)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pj
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..workers import ship

_DIGITS = 20


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _name(first: int, last: int) -> str:
    return f"page-{first:0{_DIGITS}d}-{last:0{_DIGITS}d}.json"


def _pages(folder: str) -> list[tuple[int, int, str]]:
    """(first key, last key, file) of the pages that have landed, in order."""
    fs, base = _store(folder)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("page-") and f.base_name.endswith(".json")]
    keys = lambda p: tuple(map(int, p.rsplit("/", 1)[-1][5:-5].split("-")))
    return sorted((*keys(p), p) for p in found)


def land(rows: DataFrame, folder: str, key: str, size: int = 500) -> None:
    """Writes ``rows`` as pages of at most ``size`` records. The key is a whole number, not negative; rows without one are left out, rows that share one are in one page or in adjacent ones.

    A task writes a page under another name and renames it when it is whole; a task that runs again writes the same pages.
    """
    ship(rows.sparkSession)
    ordered = rows.where(F.col(key) >= 0).repartitionByRange(key).sortWithinPartitions(key, *(c for c in rows.columns if c != key))
    lines = ordered.select(F.col(key).cast("long").alias("key"), F.to_json(F.struct(*rows.columns)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        held: list[tuple[int, str]] = []

        def write(page):
            whole, part = f"{base}/{_name(page[0][0], page[-1][0])}", f"{base}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write("".join(line + "\n" for _, line in page).encode())
            fs.move(part, whole)

        for batch in batches:
            held += zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True)
            while len(held) > size:
                # A page ends where the key changes, so that no record of a key is behind an offset that counts it as read.
                end = next((i for i in range(size, len(held)) if held[i][0] != held[i - 1][0]), None)
                if end is None:
                    break
                write(held[:end])
                held = held[end:]
        if held:
            write(held)
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    lines.mapInArrow(run, "done long").count()


class _Page(InputPartition):
    def __init__(self, path: str, lo: int, hi: int | None):
        self.path, self.lo, self.hi = path, lo, hi


class _Read:
    """What batches and streams share: records of pages with lo < key <= hi."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.key, self.after, self.schema = options["path"], options["key"], int(options.get("after", -1)), schema

    def between(self, lo: int, hi: int | None) -> list[_Page]:
        return [_Page(p, lo, hi) for first, last, p in _pages(self.folder) if last > lo and (hi is None or first <= hi)]

    def read(self, page: _Page | None) -> Iterator[pa.RecordBatch]:
        if page is None:  # Spark asks so where there are no partitions
            return
        fs, _ = _store(self.folder)
        schema = to_arrow_schema(self.schema)
        rows = pj.read_json(fs.open_input_stream(page.path), parse_options=pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")).select(schema.names)
        keys = rows.column(self.key).to_pylist()
        yield from rows.filter(pa.array([k > page.lo and (page.hi is None or k <= page.hi) for k in keys])).to_batches()


class _Batch(_Read, DataSourceReader):
    def partitions(self) -> list[_Page]:
        return self.between(self.after, None)


class _Stream(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": self.after}

    def latestOffset(self) -> dict:
        return {"after": max((last for _, last, _ in _pages(self.folder)), default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return self.between(start["after"], end["after"])


class PagedFeed(DataSource):
    """Options: path, ddl (the records' schema, with the key), key, after (-1 unless given: only records behind that key)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options, schema)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PagedFeed)
