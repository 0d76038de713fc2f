import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import evalmetrics as ev


def test_percentiles_within_the_stated_error(spark):
    """Against all values: daily sketches merged by stage, and over sliding weeks."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    daily = ev.latency_sketches(events, ["event_type", "day"], "value").cache()
    p = events.toPandas()

    def check(row, values):
        values = np.sort(values)
        assert row["n"] == len(values) and row["max"] == values[-1] and abs(row["mean"] - values.mean()) < 1e-9 * max(1, abs(values.mean()))
        for q, got in ((0.5, row["p50"]), (0.95, row["p95"])):
            lo, hi = np.searchsorted(values, got, "left") / len(values), np.searchsorted(values, got, "right") / len(values)
            assert lo - ev.RANK_ERROR - 1 / len(values) <= q <= hi + ev.RANK_ERROR + 1 / len(values)

    for row in ev.merged_latency(daily, ["event_type"]).collect():
        check(row, p.value[p.event_type == row["event_type"]].to_numpy())
    rows = ev.sliding_latency(daily, "event_type", "day", 7).collect()
    day = p.day.to_numpy()
    from datetime import timedelta

    for row in rows[::7]:
        check(row, p.value[(p.event_type == row["event_type"]) & (day <= row["day"]) & (day > row["day"] - timedelta(days=7))].to_numpy())
    assert len(rows) >= p.groupby(["event_type", "day"]).ngroups


def test_values_that_do_not_count(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, None), ("a", 2, float("nan")), ("b", 1, None)], "s string, d int, v double")
    got = ev.merged_latency(ev.latency_sketches(df, ["s", "d"], "v"), ["s"]).collect()
    assert [tuple(r) for r in got] == [("a", 1, 2.0, 2.0, 2.0, 2.0)]
    assert ev.merged_latency(ev.latency_sketches(df.limit(0), ["s", "d"], "v"), ["s"]).collect() == []
