"""Incremental ingest on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landed(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """A stream over files as they land; ``files`` bounds a micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def keyed_merge(stream: DataFrame, target: str, checkpoint: str, keys: list[str], version: str) -> StreamingQuery:
    """Runs over what has landed and stops. Each micro-batch keeps its newest row of a key and appends it with the batch's number.

    The state is the newest row of each key (``merged``); appending makes a micro-batch's cost its own size, whatever the
    table's, and a batch that runs again overwrites its own folder only, so re-delivery is harmless.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, target: str, keys: list[str], version: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("epoch"))
    return spark.read.parquet(target).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "epoch")


def windowed_counts(events: DataFrame, ts: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums in event-time windows; rows later than ``late`` are dropped in a stream. The same plan serves a batch."""
    kind = dict(events.dtypes)[ts]  # a watermark wants an instant; the result keeps the column's type
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast(kind).alias("start"), *keys, "n", "total")


def retry_state(failures: DataFrame, backoff_minutes: int = 60, most: int = 5) -> DataFrame:
    """Attempts per key, with the wait before the next retry doubling up to a bound; a stateful aggregation that runs in update mode on a stream. Times keep their column's type and every digit."""
    out = failures.groupBy("source").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    wait = F.lit(backoff_minutes) * F.pow(F.lit(2.0), F.least(F.col("attempts"), F.lit(most)) - 1)
    return out.withColumn("next_retry", F.col("last") + F.make_dt_interval(mins=wait.cast("int")))
