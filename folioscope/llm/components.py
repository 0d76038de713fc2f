"""Connected components by alternating large-star and small-star steps, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, Scratch, join_by


def _nearest(arcs: DataFrame) -> DataFrame:
    """For each u the smallest of u and its neighbours, and how many arcs it has; both are aggregated before the shuffle, so a hub costs one row a task."""
    return arcs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("arcs")).select("u", F.least("u", "m").alias("m"), "arcs")


#: Nodes, of 24 bytes each, whose table is broadcast whole.
FEW = 100_000


def _pointed(arcs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``arcs`` with the nearest of their u, and the table of those, which is written once: broadcast if it has at most FEW rows, else joined by ``join_by`` where a node has a heavy share of the arcs."""
    near = scratch.keep(_nearest(arcs), "near")
    nodes, total, most = near.agg(F.count("*"), F.sum("arcs"), F.max("arcs")).first()
    if nodes <= FEW:
        return arcs.join(F.broadcast(near), "u"), near
    return join_by(arcs, near, "u", "arcs", total) if most * HEAVY > total else arcs.join(near, "u"), near


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    arcs, near = _pointed(both, scratch)
    return arcs.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), near


def _small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    arcs, near = _pointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), scratch)
    return arcs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v"), near


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(id, component): for each end of an edge (u, v) the smallest id that it reaches.

    Self-loops and repeated edges are allowed; no edges give no rows. Each round costs two shuffles of at most as many
    edges as there were; stars converge in two rounds, and any graph in about the square of the logarithm of its size.
    Hubs don't gather their edges in one task (``join_by``).
    """
    now = scratch.keep(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = state(now)
    if not was[0]:
        return now.toDF("id", "component")
    for _ in range(limit):
        arcs, near = _large_star(now, scratch)
        half = scratch.keep(arcs.distinct(), "edges")
        scratch.drop(now, near)
        arcs, near = _small_star(half, scratch)
        new = scratch.keep(arcs.distinct(), "edges")
        scratch.drop(half, near)
        now, before = new, was
        was = state(now)
        if was == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return scratch.keep(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
