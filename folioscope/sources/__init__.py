"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; columns are pruned and filters pushed down by the plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def json_feed(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    """Landed JSON: lines, or one document a file. The schema is given, so nothing is scanned to infer it."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def fields(raw: str, **paths: tuple[str, ...]) -> list:
    """Columns from a JSON string; the first path that has a value counts."""
    return [F.coalesce(*(F.nullif(F.get_json_object(raw, p), F.lit("")) for p in some)).alias(name) for name, some in paths.items()]


def binary_texts(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, text) of binary files by a function bytes -> text; one that fails gives null."""
    def run(batches):
        import pandas as pd

        def safe(content):
            try:
                return extract(bytes(content))
            except Exception:
                return None

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [safe(c) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def index_titles(text, marker: str):
    """Rows (signature, title), to explode, of an index text: each part after the marker is a signature line and a title."""
    parts = F.filter(F.slice(F.split(text, marker), 2, 1 << 30), lambda p: F.length(F.trim(p)) > 0)
    line = lambda p: F.trim(F.split_part(p, F.lit("\n"), F.lit(1)))
    return F.transform(parts, lambda p: F.struct(line(p).alias("signature"), F.trim(F.regexp_replace(F.substring(p, F.length(F.split_part(p, F.lit("\n"), F.lit(1))) + 1, F.length(p)), r"\s+", " ")).alias("title")))


def edition_urls(base: str, day, number, language):
    return F.concat(F.lit(base.rstrip("/") + "/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), number.cast("string"), F.when(language.rlike("(?i)^(ca|va)"), F.lit("_va")).otherwise(F.lit("_es")), F.lit(".pdf"))


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Writes a table that many queries read, such as chunks or postings, in buckets by its key; joins and aggregates on the key then need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def append_log(df: DataFrame, path: str) -> None:
    """Trace rows as JSON lines. Null fields are left out and read back as null."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


#: Quotes are doubled inside quotes, as other readers of CSV expect; an empty string is quoted, a null is not.
CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """One file a partition, each with a header. Values may hold quotes, commas, and ends of lines."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote, nulls and empty strings apart. Values may span lines, so a file is one task: write as many partitions as tasks are wanted. A carriage return within a value is kept; a value that is the character 0 alone comes back null."""
    return spark.read.schema(schema).options(**CSV | {"emptyValue": "", "nullValue": "\x00", "multiLine": True, "lineSep": "\n"}).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
