"""Date ranges as sets: coalescing, difference, spines, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_ranges(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end): overlapping or adjacent (a day apart) ranges merged; inverted ones dropped."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(start) > F.date_add(reach, 1))).cast("int")
    islands = df.where(F.col(start) <= F.col(end)).withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def missing_ranges(df: DataFrame) -> DataFrame:
    """Rows (start, end, have_min, have_max, ...): one row for each part of start..end outside have_min..have_max; all of it where nothing is had."""
    none = F.col("have_min").isNull() | F.col("have_max").isNull()
    left = F.struct(F.col("start").alias("lo"), F.least("end", F.date_sub("have_min", 1)).alias("hi"))
    right = F.struct(F.greatest("start", F.date_add("have_max", 1)).alias("lo"), F.col("end").alias("hi"))
    whole = F.struct(F.col("start").alias("lo"), F.col("end").alias("hi"))
    parts = F.when(none, F.array(whole)).otherwise(F.array(F.when(F.col("start") < F.col("have_min"), left), F.when(F.col("end") > F.col("have_max"), right)))
    parts = F.filter(parts, lambda x: x.isNotNull() & (x["lo"] <= x["hi"]))
    return df.withColumn("_p", F.explode(parts)).withColumns({"lo": F.col("_p.lo"), "hi": F.col("_p.hi")}).drop("_p")


def spine(df: DataFrame, day: str, *keys: str) -> DataFrame:
    """Every day between the first and last of ``day``, for every value of the keys (dimensions of a few values; Spark broadcasts them only if they are small)."""
    days = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias(day))
    for k in keys:
        days = days.crossJoin(df.select(k).distinct())
    return days


def gaps(df: DataFrame, day: str, *keys: str) -> DataFrame:
    """The days of the spine on which a key has no row."""
    return spine(df, day, *keys).join(df.select(day, *keys).distinct(), [day, *keys], "left_anti")
