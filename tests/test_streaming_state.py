import random
from datetime import date, datetime, timedelta

import pytest

from folioscope.streaming import days, landed, retries

T0 = datetime(2024, 1, 1)
REPORT = "source string, ts timestamp, ok boolean"


def run(spark, base, batches, cfg):
    """Each batch lands and is run by itself: the query restarts from its checkpoint every time."""
    for rows in batches:
        spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = landed(spark, f"{base}/in", REPORT, files=1)
        retries.run_retries(retries.retry_changes(stream, cfg), f"{base}/out", f"{base}/check").awaitTermination()
    return retries.retry_table(spark, f"{base}/out")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_restarts_and_disorder_end_as_the_batch_fold(spark, tmp_path):
    r = random.Random(3)
    cfg = retries.RetryConfig(late="60 days")
    rows = [(f"k{r.randrange(6)}", T0 + timedelta(minutes=r.randrange(40_000), microseconds=7), r.random() < 0.2) for _ in range(150)]
    rows += [("tie", T0, False), ("tie", T0, True), ("bad", T0, False), ("bad", T0, False), (None, T0, True), ("k1", None, True), ("k1", T0, None)]
    got = run(spark, str(tmp_path), [rows[:60], rows[60:110], rows[110:]], cfg)
    assert rows_of(got) == rows_of(retries.retry_fold(spark.createDataFrame(rows, REPORT), cfg))
    assert {x[0]: x[1] for x in rows_of(got)} | {"tie": 0, "bad": 2} == {x[0]: x[1] for x in rows_of(got)}


def test_old_failures_are_counted_and_late_reports_ignored(spark, tmp_path):
    day = lambda n: T0 + timedelta(days=n)
    batches = [[("a", day(0), False), ("a", day(1), False)], [("b", day(10), True)], [("a", day(0), True), ("a", day(11), False)], [("b", day(30), True)]]
    got = {x[0]: x for x in rows_of(run(spark, str(tmp_path), batches, retries.RetryConfig(late="1 day")))}
    assert got["a"][1:4] == (3, day(11), day(11) + timedelta(minutes=240)) and got["b"][1] == 0
    due = spark.read.parquet(f"{tmp_path}/out").where("kind = 'due'").orderBy("epoch").collect()
    assert [(x["source"], x["attempts"]) for x in due][-1] == ("a", 3)


def test_keys_of_a_bucket_share_a_group_and_keep_their_own_timers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retries, "BUCKETS", 2)
    cfg = retries.RetryConfig(late="1 day")
    day = lambda n, hours=0: T0 + timedelta(days=n, hours=hours)
    batches = [[(f"k{i}", day(i, n), False) for i in range(12) for n in range(1 + i % 3)], [(f"k{i}", day(11, 5), True) for i in (3, 11)], [("late", day(1), False), ("z", day(60), True)]]
    got = run(spark, str(tmp_path), batches, cfg)
    rows = [x for batch in batches for x in batch if x[0] != "late"]
    assert [x for x in rows_of(got) if x[0] != "late"] == rows_of(retries.retry_fold(spark.createDataFrame(rows, REPORT), cfg))
    due = spark.read.parquet(f"{tmp_path}/out").where("kind = 'due'").select("source", "attempts", "last", "next_retry").collect()
    wait = [60, 120, 240]
    assert sorted(map(tuple, due)) == sorted((f"k{i}", 1 + i % 3, day(i, i % 3), day(i, i % 3) + timedelta(minutes=wait[i % 3])) for i in range(11))
    stream = landed(spark, f"{tmp_path}/in", REPORT, files=9)
    query = retries.run_retries(retries.retry_changes(stream, cfg), f"{tmp_path}/out2", f"{tmp_path}/check2")
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


# -- days ---------------------------------------------------------------------------------------------------------------

DAY = "id long, day date, lang string, value long, sent timestamp"


def delivery(n, lang, value, sent, count=3):
    return [(n * 10 + i, date(2024, 1, 1) + timedelta(days=n), lang, value, T0 + timedelta(days=sent)) for i in range(count)]


def test_late_repeated_and_missing_days_end_as_one_clean_batch(spark, tmp_path):
    every = [delivery(n, lang, n, n) for n in range(60) for lang in ("es", "va")]
    corrected = delivery(7, "es", 700, 20, 2)  # a day with fewer rows than before
    lost = {(3, "es"), (40, "va"), (41, "es"), (42, "va"), (55, "es")}
    fed = [d for d in every if (d[0][1].timetuple().tm_yday - 1, d[0][2]) not in lost]
    r = random.Random(1)
    r.shuffle(fed)  # late ones among them
    batches = [fed[:50], [fed[3], corrected, fed[3]], [*fed[50:], delivery(7, "es", 7, 7)], [fed[9], fed[70]]]
    base, keys = str(tmp_path), ["day", "lang"]
    for deliveries in batches:
        spark.createDataFrame(sum(deliveries, []), DAY).coalesce(1).write.mode("append").parquet(f"{base}/in")
        days.ingest_days(landed(spark, f"{base}/in", DAY, files=1), f"{base}/table", f"{base}/check", keys, "sent", ["id"], "90 days").awaitTermination()
    source = spark.createDataFrame(sum(every, []) + corrected, DAY)
    have = lambda: sorted(map(tuple, spark.read.parquet(f"{base}/table").select("id", "day", "lang", "value", "sent").collect()))
    clean = sorted(map(tuple, days.newest_delivery(source, keys, "sent").collect()))
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    gone = {(day(n), lang) for n, lang in lost}
    assert have() == [x for x in clean if (x[1], x[2]) not in gone]
    ranges = days.repair(spark, f"{base}/table", source, "day", "lang", keys, "sent", ["es", "va"], day(0), day(59))
    assert sorted(map(tuple, ranges.collect())) == [(day(40), day(42)), (day(55), day(55))]
    assert have() == [x for x in clean if (x[1], x[2]) != (day(3), "es")]  # beyond the scan's 45 days


def test_gap_scan(spark):
    have = spark.createDataFrame([(date(2024, 3, 1), "es"), (date(2024, 3, 3), None)], "day date, lang string")
    scan = lambda start, end, most=45: sorted((str(r["day"]), r["lang"]) for r in days.gap_candidates(have, "day", "lang", ["es", "va"], start, end, most).collect())
    assert scan(date(2024, 2, 29), date(2024, 3, 1)) == [("2024-02-29", "es"), ("2024-02-29", "va"), ("2024-03-01", "va")]
    assert len(scan(date(2020, 1, 1), date(2024, 2, 1))) == 90 and len(scan(date(2020, 1, 1), date(2024, 3, 1), 2)) == 3
    assert scan(date(2024, 3, 2), date(2024, 3, 1)) == []
    candidates = days.gap_candidates(have, "day", "lang", ["es", "va"], date(2024, 2, 27), date(2024, 3, 1))
    source = spark.createDataFrame([(date(2024, 2, 27), "es", 4), (date(2024, 2, 28), "va", 1), (date(2024, 2, 29), "es", 0), (date(2024, 2, 29), "va", None)], "day date, lang string, n long")
    ranges, summary = days.repair_ranges(candidates, source, "day", "lang")
    assert [tuple(map(str, r)) for r in ranges.collect()] == [("2024-02-27", "2024-02-28")]
    assert tuple(summary.first()) == (7, 6, 2, 1)


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1, T0)], [(1, date(2024, 1, 1), "es", 1, None)]])
def test_rows_with_nulls(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, DAY)
    days.write_days(df, str(tmp_path / "t"), ["day", "lang"], "sent")
    days.write_days(df, str(tmp_path / "t"), ["day", "lang"], "sent")
    table = spark.read.schema(DAY).parquet(str(tmp_path / "t")) if rows and rows[0][-1] else df.limit(0)
    assert table.count() == (1 if rows and rows[0][-1] else 0)
