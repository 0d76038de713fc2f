"""What executors need: the package in their Python workers, and a folder that all of them see."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARCHIVE = "folioscope.zip"


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset a local session (tests) gets a folder of its own; on a cluster that is an error, for other machines wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def ship(spark: SparkSession) -> None:
    """Adds the package to the context's files, once."""
    sc = spark.sparkContext
    if ARCHIVE in sc._python_includes:
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp()) / ARCHIVE
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(to))


class Shared:
    """Tables under the shared checkpoint folder: they cut lineage, survive a lost executor, and go with ``drop`` or, all at once, with ``clear``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.base)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path, as the JVM has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = hadoop(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
