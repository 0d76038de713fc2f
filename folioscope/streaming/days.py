"""Daily deliveries: late, repeated and missing days end in the table that one clean batch would have made."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.intervals import coalesce_ranges
from ..workers import checkpoint_folder, children


def write_days(rows: DataFrame, target: str, keys: list[str], version: str) -> None:
    """Replaces the partitions (keys) that ``rows`` deliver, each by its newest delivery, unless the table has a newer one.

    A delivery is all rows of a partition with one ``version``. Other partitions aren't touched or read; running again
    with the same rows changes nothing.
    """
    spark = rows.sparkSession
    checkpoint_folder(spark)
    newest = rows.where(F.col(version).isNotNull()).groupBy(*keys).agg(F.max(version).alias("_new"))
    if children(spark, target):
        have = spark.read.parquet(target).groupBy(*keys).agg(F.max(version).alias("_had"))
        newest = newest.join(have, [newest[k].eqNullSafe(have[k]) for k in keys], "left").where("_had is null or _had <= _new").select(*(newest[k] for k in keys), "_new")
    joined = rows.join(newest.select(*(F.col(k).alias(f"_{k}") for k in keys), "_new"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    out = joined.where(F.col(version) == F.col("_new")).select(*rows.columns).checkpoint()  # the table that is read is the one that is written
    out.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)


def ingest_days(stream: DataFrame, target: str, checkpoint: str, keys: list[str], version: str, ids: list[str], late: str = "30 days") -> StreamingQuery:
    """Runs over what has landed and stops. Rows that were delivered again within ``late`` of their ``version`` (a time) are dropped as they come; what is left replaces its partitions."""
    rows = stream.withWatermark(version, late).dropDuplicatesWithinWatermark([*keys, version, *ids])
    return rows.writeStream.foreachBatch(lambda batch, _: write_days(batch, target, keys, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_candidates(have: DataFrame, day: str, key: str, wanted: list[str], start: date, end: date, most: int = 45) -> DataFrame:
    """(day, key): the days of the last ``most`` up to ``end``, and not before ``start``, on which a wanted key has no row. ``most`` bounds the scan, whatever the table's age."""
    spark = have.sparkSession
    first = F.greatest(F.lit(start), F.date_sub(F.lit(end), most - 1))
    days = spark.range(1).select(F.explode(F.filter(F.sequence(F.least(first, F.lit(end)), F.lit(end)), lambda d: d >= first)).alias(day))
    spine = days.withColumn(key, F.explode(F.array(*map(F.lit, wanted))))
    near = have.where((F.col(day) >= first) & (F.col(day) <= F.lit(end)))
    return spine.join(near.select(day, key).distinct(), [day, key], "left_anti")


def repair_ranges(candidates: DataFrame, source: DataFrame, day: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((start, end), summary): the merged ranges of days on which the source has something for a candidate, and how many candidates there are, were answered (source: day, key, n, null where asking failed), and have something."""
    checked = candidates.join(source.groupBy(day, key).agg(F.count("*").alias("_asked"), F.sum("n").alias("_n")), [day, key], "left")
    failed = F.col("_asked").isNotNull() & F.col("_n").isNull()
    some = checked.where("_n > 0").select(F.lit(0).alias("_k"), F.col(day).alias("start"), F.col(day).alias("end")).distinct()
    summary = checked.agg(F.count("*").alias("candidate_pairs"), F.count_if(~failed).alias("checked_pairs"), F.count_if(F.col("_n") > 0).alias("source_positive_pairs"), F.count_if(failed).alias("failed_source_checks"))
    return coalesce_ranges(some, "_k").select("start", "end"), summary


def repair(spark: SparkSession, target: str, source: DataFrame, day: str, key: str, keys: list[str], version: str, wanted: list[str], start: date, end: date, most: int = 45) -> DataFrame:
    """Finds the missing days of the table and writes what the source has for their ranges, as a delivery like any other; returns the ranges."""
    checkpoint_folder(spark)
    candidates = gap_candidates(spark.read.parquet(target), day, key, wanted, start, end, most)
    counts = source.groupBy(day, key).agg(F.count("*").alias("n"))
    ranges, _ = repair_ranges(candidates, counts, day, key)
    ranges = ranges.checkpoint()
    rows = source.join(F.broadcast(ranges), (F.col(day) >= F.col("start")) & (F.col(day) <= F.col("end"))).select(*source.columns)  # ``most`` ranges at most
    write_days(rows, target, keys, version)
    return ranges


def newest_delivery(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """What one clean batch keeps: of each partition the rows of its newest delivery."""
    top = F.max(version).over(Window.partitionBy(*keys))
    return rows.withColumn("_top", top).where(F.col(version) == F.col("_top")).drop("_top")
