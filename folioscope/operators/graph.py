"""Similarity families and the reference graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, norm
from ..workers import checkpoint_folder


def _checkpoint(df: DataFrame) -> DataFrame:
    return df.checkpoint() if checkpoint_folder(df.sparkSession) else df


def similar_pairs(vectors: DataFrame, block: str, threshold: float) -> DataFrame:
    """(block, a, b, sim): pairs a < b of one block with cosine at or above the threshold; norms are computed once a row.

    A block is an id set of bounded size, such as the pool of one question; all of its pairs are compared.
    """
    v = vectors.select(block, "id", "embedding", norm("embedding").alias("norm"))
    b = v.select(block, F.col("id").alias("b"), F.col("embedding").alias("eb"), F.col("norm").alias("nb"))
    pairs = v.withColumnRenamed("id", "a").join(b, block).where("a < b")
    return pairs.select(block, "a", "b", cosine("embedding", "eb", F.col("norm"), F.col("nb")).alias("sim")).where(F.round("sim", 6) >= threshold)


def families(pairs: DataFrame, block: str, limit: int = 50) -> DataFrame:
    """(block, id, family): smallest id reachable within the block. The smallest label spreads along edges and then along labels; each round is checkpointed to the shared folder, and the loop ends when the labels' sum stays."""
    both = _checkpoint(pairs.select(block, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(block, F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = _checkpoint(both.groupBy(block, "u").agg(F.min("v").alias("m")).select(block, F.col("u").alias("id"), F.least("u", "m").alias("family")))
    total = labels.agg(F.sum("family")).first()[0]
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("id", "v"), [block, "v"]).groupBy(block, "u").agg(F.min("family").alias("m")).withColumnRenamed("u", "id")
        low = labels.join(near, [block, "id"]).select(block, "id", F.least("family", "m").alias("family"))
        up = low.select(block, F.col("id").alias("family"), F.col("family").alias("up"))
        labels = _checkpoint(low.join(up, [block, "family"], "left").select(block, "id", F.coalesce("up", "family").alias("family")))
        new = labels.agg(F.sum("family")).first()[0]
        if new == total:
            return labels
        total = new
    raise RuntimeError(f"families did not settle in {limit} rounds")


def stale_members(families_: DataFrame, dates: DataFrame, block: str, protected: Column | None = None, most: int | None = None) -> DataFrame:
    """(block, id, family, date): members older than the newest of their family. Unknown dates are never stale; protected ids stay; a family that would lose more than ``most`` loses none."""
    w = Window.partitionBy(block, "family")
    rows = families_.join(dates, "id").withColumn("newest", F.max("date").over(w))
    old = (F.col("date") < F.col("newest")) & ~(F.lit(False) if protected is None else protected)
    rows = rows.withColumn("old", F.coalesce(old, F.lit(False))).withColumn("drops", F.sum(F.col("old").cast("int")).over(w))
    out = rows.where("old")
    return (out.where(F.col("drops") <= most) if most is not None else out).select(block, "id", "family", "date")


def veto(title_a: Column, title_b: Column, stems: list[str], code: str) -> Column:
    """Two titles that can't be editions of one act: they name different acts, or each has codes and none in common."""
    def stem(t: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for s in stems:
            out = out.when(F.contains(F.lower(t), F.lit(s)), F.lit(s))
        return out

    codes = lambda t: F.regexp_extract_all(F.lower(t), F.lit(code), F.lit(0))
    a, b = codes(title_a), codes(title_b)
    return F.coalesce(stem(title_a) != stem(title_b), F.lit(False)) | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))


def companions(edges: DataFrame, seeds: DataFrame, hub: int, priority: list[str], limit: int) -> DataFrame:
    """(qid, doc_id, rank): neighbours of seeds (qid, doc_id) over edges (src, dst, kind), both ways, without documents that more than ``hub`` edges point to.

    Each direction is an equi-join of its own.
    """
    known = edges.where("dst is not null and src <> dst")
    known = known.withColumn("degree", F.count("*").over(Window.partitionBy("dst"))).where(F.col("degree") <= hub)
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("kind"))
    out = seeds.join(known, seeds["doc_id"] == known["src"]).select("qid", F.col("dst").alias("doc_id"), order.alias("p"))
    into = seeds.join(known, seeds["doc_id"] == known["dst"]).select("qid", F.col("src").alias("doc_id"), order.alias("p"))
    near = out.unionByName(into).where("p > 0").groupBy("qid", "doc_id").agg(F.min("p").alias("p")).join(seeds, ["qid", "doc_id"], "left_anti")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("p", "doc_id")).cast("long")).where(F.col("rank") <= limit).select("qid", "doc_id", "rank")
