"""One writer at a time, without a database: a lease with a fencing number, by files that only one can create.

    <path>/leases/<number>     the owner and when the lease ends; the highest number holds it
    <path>/commits/<number>    what was committed, by which lease

A writer that lost its lease, because it paused past its end and another took over, is refused: a commit takes the next number, and
readers skip a commit whose lease is older than that of a commit before it. The folder must be on a file system that creates a file
exclusively, such as HDFS or a local disk.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..workers import children, hadoop


class LeaseLost(RuntimeError):
    """Another writer holds the lease."""


def _create(spark: SparkSession, path: str, content: dict) -> bool:
    """Creates a file; False if it is there already. A file is complete when it can be read as JSON."""
    fs, p = hadoop(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(p):
            return False
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> dict | None:
    """The content, or None of a file whose writer died before it was complete."""
    fs, p = hadoop(spark, path)
    file = fs.open(p)
    try:
        return json.loads(bytes(file.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        file.close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(x) for x in children(spark, path) if x.isdigit())


@dataclass(frozen=True)
class Lease:
    spark: SparkSession
    path: str
    owner: str
    number: int

    @staticmethod
    def acquire(spark: SparkSession, path: str, owner: str, now: float, seconds: float) -> Lease | None:
        """The lease from ``now`` (a time in seconds) on, or None while another's lasts. A lease that ended, was released or whose writer died while it wrote it passes on; of two that reach for it one wins."""
        numbers = _numbers(spark, f"{path}/leases")
        if numbers:
            held = _read(spark, f"{path}/leases/{numbers[-1]}")
            if held and held["ends"] > now and f"{numbers[-1]}" not in children(spark, f"{path}/released"):
                return None
        number = (numbers[-1] if numbers else 0) + 1
        return Lease(spark, path, owner, number) if _create(spark, f"{path}/leases/{number}", {"owner": owner, "ends": now + seconds}) else None

    def holds(self) -> bool:
        return _numbers(self.spark, f"{self.path}/leases")[-1] == self.number

    def release(self) -> None:
        _create(self.spark, f"{self.path}/released/{self.number}", {"owner": self.owner})

    def commit(self, what: dict) -> int:
        """Records ``what`` as the next commit and returns its number; LeaseLost if a newer lease was given out, or another writer committed meanwhile."""
        if not self.holds():
            raise LeaseLost(f"lease {self.number} of {self.owner} was taken over")
        done = _numbers(self.spark, f"{self.path}/commits")
        number = (done[-1] if done else 0) + 1
        if not _create(self.spark, f"{self.path}/commits/{number}", {"lease": self.number, "owner": self.owner, "what": what}):
            raise LeaseLost(f"commit {number} was another writer's")
        return number


def committed(spark: SparkSession, path: str) -> list[dict]:
    """What counts, in order: commits of a lease that no earlier commit's lease exceeds."""
    out, newest = [], 0
    for n in _numbers(spark, f"{path}/commits"):
        row = _read(spark, f"{path}/commits/{n}")
        if row and row["lease"] >= newest:
            newest = row["lease"]
            out.append(row["what"])
    return out
