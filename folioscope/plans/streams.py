"""Streams over ``events`` that end in tables; the events are landed in several files, so that they come in several micro-batches."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..streaming import days, landed, retries
from ..workers import Shared
from . import query


def _landing(df, name: str, files: int, by: str):
    """(folder, base): ``df`` as files of a folder that a stream can read."""
    spark = df.sparkSession
    base = Shared(spark, name).base
    df.repartitionByRange(files, by).write.parquet(f"{base}/in")
    return f"{base}/in", base


@query("""with e as (select user_id::varchar source, ts, event_type <> 'error' ok from events), s as (select source, max(ts) filter (ok) success from e group by 1),
f as (select source, count(*) filter (not ok and (success is null or ts > success)) attempts, max(ts) filter (not ok) last from e join s using (source) group by 1)
select source, attempts, last::timestamp as last, case when attempts > 0 then last + to_minutes(cast(60 * pow(2, least(attempts, 5) - 1) as integer)) end next_retry, attempts = 0 resolved from f""")
def retry_state_stream(t):
    """Retry state of every user, kept over a stream in four micro-batches: errors are failures, other events successes."""
    rows = t("events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    spark = rows.sparkSession
    folder, base = _landing(rows, "retries", 8, "ts")
    stream = landed(spark, folder, rows.schema, files=2)
    retries.run_retries(retries.retry_changes(stream, retries.RetryConfig(late="400 days")), f"{base}/out", f"{base}/check").awaitTermination()
    kind = dict(t("events").dtypes)["ts"]
    return retries.retry_table(spark, f"{base}/out").select("source", "attempts", F.col("last").cast(kind).alias("last"), F.col("next_retry").cast(kind).alias("next_retry"), "resolved")


@query("""with e as (select *, ts::date as "day" from events), b as (select max("day") hi from e) select "day", event_type, count(*) n, round(sum(value), 4) total from e, b
where not (event_type = 'error' and dayofmonth("day") % 4 = 1 and "day" < hi - 44) group by 1, 2""")
def repaired_days(t):
    """Days that come twice, late or not at all: every fourth day's errors are missing from the feed, and a repair of the last 45 days brings them."""
    spark = t("events").sparkSession
    rows = t("events").select("event_id", F.col("ts").cast("date").alias("day"), "event_type", F.col("value"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("sent"))
    missing = (F.col("event_type") == "error") & (F.dayofmonth("day") % 4 == 1)
    fed = rows.where(~missing)
    again = fed.where(F.dayofmonth("day") % 5 == 2)
    corrected = fed.where(F.dayofmonth("day") % 7 == 3)
    wrong = corrected.withColumns({"value": F.col("value") + 1, "sent": F.lit("2024-05-31 00:00:00").cast("timestamp")})
    folder, base = _landing(fed.unionByName(again).unionByName(wrong), "days", 6, "event_id")
    keys = ["day", "event_type"]
    # A day's delivery must be whole in its micro-batch, so all files are one here; the tests deliver day by day.
    days.ingest_days(landed(spark, folder, rows.schema, files=100), f"{base}/table", f"{base}/check", keys, "sent", ["event_id"]).awaitTermination()
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    if last is not None:
        days.repair(spark, f"{base}/table", rows, "day", "event_type", keys, "sent", ["error"], max(first, last - timedelta(days=3650)), last)
    return spark.read.parquet(f"{base}/table").groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
