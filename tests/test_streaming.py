from pyspark.sql import functions as F

from folioscope import streaming


def test_keyed_merge_is_idempotent(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k long, v long, name string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], schema).write.mode("append").parquet(src)
    run = lambda: streaming.keyed_merge(streaming.landed(spark, src, schema), out, check, ["k"], "v").awaitTermination()
    state = lambda: {r["k"]: r["name"] for r in streaming.merged(spark, out, ["k"], "v").collect()}
    run()
    assert state() == {1: "c", 2: "b"}
    spark.createDataFrame([(2, 5, "d"), (1, 1, "old")], schema).write.mode("append").parquet(src)
    run()
    run()
    assert state() == {1: "c", 2: "d"}


def test_windowed_counts_stream_as_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "events")
    events.repartition(3).write.parquet(src)
    stream = streaming.windowed_counts(streaming.landed(spark, src, events.schema), "ts", "1 day", "400 days", "event_type")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("counts")) == rows(streaming.windowed_counts(events, "ts", "1 day", "1 day", "event_type"))


def test_retry_state_backs_off(spark):
    f = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:00:00")], "source string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["source"]: (r["attempts"], str(r["next_retry"])) for r in streaming.retry_state(f).collect()}
    assert got == {"a": (2, "2024-01-01 03:00:00"), "b": (1, "2024-01-01 01:00:00")}
