"""Retry state of a source by key, kept by a stateful stream: attempts since the last success, when to try again, and a timer that says so."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..workers import ship

ROW = "source string, kind string, attempts long, last timestamp, next_retry timestamp, resolved boolean"
#: A change as it leaves Python, times in microseconds.
CHANGE = "source string, kind string, attempts long, last long, next_retry long, resolved boolean"
#: Of each key of a bucket, at the same place of every array. folded: failures too old to be reordered; recent: times of the others
#: (microseconds); success, last: the newest of each; timer: when ``due`` is to be said (milliseconds).
STATE = "source array<string>, folded array<long>, recent array<array<long>>, success array<long>, last array<long>, timer array<long>"
#: Keys meet Python in so many groups, for a group costs milliseconds there and a key microseconds. A checkpoint holds them: another number needs a new one.
BUCKETS = 1024


@dataclass(frozen=True)
class RetryConfig:
    """minutes: wait after the first failure, doubling with each further one up to the ``most``-th. late: how far out of order reports may come."""

    minutes: int = 60
    most: int = 5
    late: str = "2 days"


def _wait(attempts: int, cfg: RetryConfig) -> int:
    return cfg.minutes * 60_000_000 * 2 ** (min(attempts, cfg.most) - 1)


def _reported(frames: Iterator[pd.DataFrame], floor: int) -> dict[str, list]:
    """By source: times of its failures, and its newest success."""
    new: dict[str, list] = {}
    for rows in frames:
        for source, at, ok in zip(rows["source"].tolist(), rows["at"].tolist(), rows["ok"].tolist(), strict=True):
            mine = new.setdefault(source, [[], None])
            if at < floor:
                continue
            if not ok:
                mine[0].append(at)
            elif mine[1] is None or at > mine[1]:
                mine[1] = at
    return new


def _step(cfg: RetryConfig):
    def change(source: str, kind: str, attempts: int, last: int | None) -> tuple:
        return source, kind, attempts, last, last + _wait(attempts, cfg) if attempts else None, attempts == 0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = {source: tuple(rest) for source, *rest in zip(*state.get, strict=True)} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        floor, out = now * 1000, []
        for source, (bad, good) in ({} if state.hasTimedOut else _reported(frames, floor)).items():
            folded, recent, success, last, _ = keys.get(source, (0, [], None, None, None))
            recent = [*recent, *bad]
            last = max([*bad, *([] if last is None else [last])], default=None)
            success = max((x for x in (success, good) if x is not None), default=None)
            if success is not None:
                # Failures that were folded are older than any report that can still come, so a newer success ends them all.
                folded = 0 if success >= floor else folded
                recent = [x for x in recent if x > success]
            folded += sum(x < floor for x in recent)
            recent = sorted(x for x in recent if x >= floor)
            attempts = folded + len(recent)
            again = last + _wait(attempts, cfg) if attempts else None
            over = again is not None and again <= floor
            keys[source] = folded, recent, success, last, None if again is None or over else again // 1000 + 1
            out += [change(source, kind, attempts, last) for kind in (("state", "due") if over else ("state",))]
        # Timers of keys without reports; those set above are never before the watermark.
        for source, (folded, recent, success, last, timer) in keys.items():
            if timer is not None and timer < now:
                keys[source] = folded, recent, success, last, None
                out.append(change(source, "due", folded + len(recent), last))
        state.update((list(keys), *map(list, zip(*keys.values(), strict=True))))
        timers = [x[-1] for x in keys.values() if x[-1] is not None]
        if timers:
            state.setTimeoutTimestamp(min(timers))
        if out:
            frame = pd.DataFrame(out, columns=["source", "kind", "attempts", "last", "next_retry", "resolved"], dtype=object)  # no long becomes a double
            yield frame.astype({"attempts": "int64", "last": "Int64", "next_retry": "Int64", "resolved": bool})

    return step


def retry_changes(reports: DataFrame, cfg: RetryConfig | None = None) -> DataFrame:
    """The stream of changes (ROW) to the retry state, of reports (source, ts, ok).

    A failure adds an attempt and reopens; a success clears the attempts that came before or with it and resolves. Reports may come in any
    order within cfg.late, and the state is the same; older ones are ignored. A row of kind ``due`` comes when event time has
    passed next_retry and nothing was reported since, or at once where it had passed before the report came. Rows with a null are ignored. The state of a key is its counts and the failures within cfg.late;
    keys are kept in BUCKETS groups by their hash, each with the earliest timer of its keys.
    """
    cfg = cfg or RetryConfig()
    ship(reports.sparkSession)
    rows = reports.where("source is not null and ts is not null and ok is not null").select(F.col("source").cast("string"), F.col("ts").cast("timestamp"), "ok").withWatermark("ts", cfg.late)
    dealt = rows.withColumns({"bucket": F.pmod(F.xxhash64("source"), F.lit(BUCKETS)), "at": F.unix_micros("ts")})
    out = dealt.groupBy("bucket").applyInPandasWithState(_step(cfg), CHANGE, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({x: F.timestamp_micros(x) for x in ("last", "next_retry")})


def run_retries(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs over what has landed and stops; a micro-batch that runs again overwrites its own folder."""
    return changes.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_table(spark: SparkSession, target: str) -> DataFrame:
    """(source, attempts, last, next_retry, resolved): the newest state of each key."""
    newest = Window.partitionBy("source").orderBy(F.desc("epoch"))
    rows = spark.read.parquet(target).where("kind = 'state'").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return rows.select("source", "attempts", "last", "next_retry", "resolved")


def retry_fold(reports: DataFrame, cfg: RetryConfig | None = None) -> DataFrame:
    """The same table from all reports at once."""
    cfg = cfg or RetryConfig()
    rows = reports.where("source is not null and ts is not null and ok is not null").select(F.col("source").cast("string"), F.col("ts").cast("timestamp"), "ok")
    at = rows.groupBy("source", "ts").agg(F.bool_or("ok").alias("good"), F.sum((~F.col("ok")).cast("long")).alias("bad"))
    success = F.max(F.when(F.col("good"), F.col("ts"))).over(Window.partitionBy("source"))
    open_ = F.col("success").isNull() | (F.col("ts") > F.col("success"))
    out = at.withColumn("success", success).groupBy("source").agg(F.coalesce(F.sum(F.when(open_, F.col("bad"))), F.lit(0)).cast("long").alias("attempts"), F.max(F.when(F.col("bad") > 0, F.col("ts"))).alias("last"))
    wait = F.make_dt_interval(mins=(F.lit(cfg.minutes) * F.pow(F.lit(2.0), F.least("attempts", F.lit(cfg.most)) - 1)).cast("int"))
    return out.withColumn("next_retry", F.when(F.col("attempts") > 0, F.col("last") + wait)).withColumn("resolved", F.col("attempts") == 0)
