"""An inverted-file index of vectors that is kept: a coarse quantiser, and the vectors in a table partitioned by cell.

A search reads the cells nearest to each question, under filters on the vectors' other columns, and goes on to further
cells for the questions that the filters leave with too few results. Over all cells it is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import Shared, ship


@dataclass(frozen=True)
class IndexConfig:
    """cells: of the quantiser at most. sample: rows that it is fitted on at most. block: vectors, and questions, that one task compares on average; fuller cells are cut."""

    cells: int = 64
    sample: int = 16384
    rounds: int = 8
    block: int = 4096
    seed: int = 3


def usable(vector: str = "embedding") -> Column:
    """Vectors that have a direction: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(col: pa.Array) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _fit(x: np.ndarray, cfg: IndexConfig) -> np.ndarray:
    centers = x[np.random.default_rng(cfg.seed).choice(len(x), min(cfg.cells, len(x)), replace=False)]
    for _ in range(cfg.rounds):
        near = (x @ centers.T).argmax(axis=1)
        used = np.unique(near)
        means = np.stack([x[near == c].mean(axis=0) for c in used])
        size = np.sqrt((means * means).sum(axis=1))
        centers = means[size > 1e-12] / size[size > 1e-12, None]
    return centers


def _with_cell(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])


def build(vectors: DataFrame, path: str, cfg: IndexConfig | None = None) -> None:
    """Writes the index of ``vectors`` (id, embedding, and columns to filter by) to ``path``.

    Vectors that are null or zero, that hold null or non-finite components, or that aren't as long as most of the sample are left out, as
    are rows without an id. A table without any usable vector gives an index without cells. The sample, cfg.sample rows, is all that reaches the driver.
    """
    cfg = cfg or IndexConfig()
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col("id").isNotNull() & usable()).withColumn("embedding", F.col("embedding").cast("array<double>"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(cfg.sample).select("embedding").toArrow().column(0).combine_chunks()
    size = some.value_lengths().to_numpy()
    dim = int(np.bincount(size).argmax()) if len(some) else 0
    centers = _fit(_unit(some.filter(pa.array(size == dim))), cfg) if dim else np.zeros((0, 1))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    shared = spark.sparkContext.broadcast(centers)  # cfg.cells rows

    def file(batches):
        for batch in batches:
            if len(batch):
                cell = (_unit(batch.column("embedding")) @ shared.value.T).argmax(axis=1) if len(shared.value) else np.zeros(len(batch), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    filed = rows.where(F.size("embedding") == dim).mapInArrow(file, _with_cell(rows))
    # A cell's rows go to several tasks, by id, so that a full cell isn't written by one.
    filed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/cells")


def _compare(asked: pa.Table, rows: pa.Table, k: int, filters: list[str]) -> pa.Table:
    i = j = np.zeros(0, np.int64)
    score = np.zeros(0)
    if asked.num_rows and rows.num_rows:
        rows = rows.sort_by("id")
        score = np.round(_unit(asked.column("vector").combine_chunks()) @ _unit(rows.column("embedding").combine_chunks()).T, 6)
        for f in filters:
            both = pa.chunked_array([*asked.column(f"want_{f}").chunks, *rows.column(f).chunks]).combine_chunks().dictionary_encode()
            code = both.indices.fill_null(-1).to_numpy()
            want, have = code[: asked.num_rows, None], code[None, asked.num_rows :]
            score[(want >= 0) & (want != have)] = -np.inf
        if score.shape[1] > k:
            least = np.partition(score, -k, axis=1)[:, -k][:, None]
            tie = score == least
            keep = (score > least) | (tie & (np.cumsum(tie, axis=1) <= k - (score > least).sum(axis=1)[:, None]))
        else:
            keep = np.ones(score.shape, dtype=bool)
        i, j = np.nonzero(keep & (score > -np.inf))
        score = score[i, j]
    return pa.table([asked.column("qid").take(pa.array(i)), rows.column("id").take(pa.array(j)), pa.array(score)], names=["qid", "id", "score"])


def _probed(cells: DataFrame, visits: DataFrame, k: int, filters: list[str], cfg: IndexConfig) -> DataFrame:
    """(qid, id, score): the k best of every block of every visited cell."""
    many = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias(name))
    plan = F.broadcast(many(cells, "nv").join(many(visits, "nq"), "cell"))  # one row a cell
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(plan, "cell").select("cell", "qid", "vector", *(f"want_{f}" for f in filters), place("qid", "nq").alias("qb"), every("nv").alias("vb"))
    right = cells.join(plan, "cell").select("cell", "id", "embedding", *filters, place("id", "nv").alias("vb"), every("nq").alias("qb"))
    schema = f"qid {dict(visits.dtypes)['qid']}, id {dict(cells.dtypes)['id']}, score double"
    return left.groupBy("cell", "vb", "qb").cogroup(right.groupBy("cell", "vb", "qb")).applyInArrow(lambda a, b: _compare(a, b, k, filters), schema)


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, probe: int | None = None, filters: tuple[str, ...] = (), least: int = 1, cfg: IndexConfig | None = None) -> DataFrame:
    """(qid, id, score, rank, probed): each question's k nearest by cosine, to six digits, ties to the smaller id.

    ``questions`` has qid, vector and, for each filter, want_<filter>: the value asked for, null for any. ``probe`` cells
    are read, nearest first, and four times as many in each further round for the questions with fewer than ``least``
    results, up to all; without ``probe`` all are read at once and the result is exact. ``probed`` says how many were read. Questions whose vector isn't
    usable or of another length have no rows; questions that share a qid are an error of the caller's.
    """
    cfg = cfg or IndexConfig()
    ship(spark)
    centers = spark.read.parquet(f"{path}/centers").orderBy("cell").toArrow().column("center").combine_chunks()
    centers = centers.flatten().to_numpy().reshape(len(centers), -1) if len(centers) else np.zeros((0, 1))
    shared, scratch, filters = spark.sparkContext.broadcast(centers), Shared(spark, "search"), list(filters)
    cells = spark.read.parquet(f"{path}/cells") if len(centers) else None
    asked = questions.where(usable("vector") & (F.size("vector") == centers.shape[1])).select("qid", F.col("vector").cast("array<double>").alias("vector"), *(F.col(f"want_{f}") for f in filters))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("long")
    empty = spark.createDataFrame([], f"qid {dict(asked.dtypes)['qid']}, id {dict(cells.dtypes)['id'] if cells else 'long'}, score double")
    if cells is None:
        return empty.withColumn("rank", rank).withColumn("probed", F.lit(0))
    asked, found, done, at, width = scratch.keep(asked, "asked"), [], [], 0, probe or len(centers)

    def order(lo: int, hi: int):
        def run(batches):
            for batch in batches:
                if len(batch):
                    near = np.argsort(-(_unit(batch.column("vector")) @ shared.value.T), axis=1, kind="stable")[:, lo:hi]
                    out = batch.take(pa.array(np.repeat(np.arange(len(batch)), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int32))], names=[*out.schema.names, "cell"])

        return run

    open_ = asked
    while True:
        to = min(at + width, len(centers))
        visits = scratch.keep(open_.mapInArrow(order(at, to), _with_cell(asked)), "visits")
        # The join on cell prunes the partitions that no question visits.
        found.append(scratch.keep(_probed(cells.join(F.broadcast(visits.select("cell").distinct()), "cell", "left_semi"), visits, k, filters, cfg), "found"))
        done.append(scratch.keep(open_.select("qid", F.lit(to).alias("probed")), "done"))
        at, width = to, width * 4
        if at == len(centers):
            break
        few = reduce(DataFrame.unionByName, found).groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        open_ = open_.join(few.select("qid"), "qid", "left_anti")
        if open_.isEmpty():
            break
    probed = reduce(DataFrame.unionByName, done).groupBy("qid").agg(F.max("probed").alias("probed"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).join(probed, "qid").select("qid", "id", "score", "rank", "probed")
