"""Hard negatives by exact inner-product search over k-means inverted lists.

Every vector is filed under its nearest centre; a list stores its centre c and its radius r, the largest distance of a
member from c. By Cauchy-Schwarz a member scores between <a, c> - |a| r and <a, c> + |a| r against an anchor a. Lists are
visited in order of their upper bounds; those whose bounds lie outside the score window are skipped, and the visits stop
when the bound falls strictly below the kth score, so nothing is lost and ties are settled by vec_id.

Neighbouring lists are packed into shards of about cfg.block rows and larger lists are cut into several, so that a
task compares one block of anchors with one shard. A first round visits each anchor's best shards, which gives it a kth
score; a second round visits the others that its bounds still allow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class MiningConfig:
    """positives, negatives: how many of each. low, high: the window of a negative's score in hundredths of the positive's. scale: components become floor(scale * x). sample: rows that the centres are fitted on at most. lists: inverted lists at most. first: shards of the first round. block: rows of a shard, and anchors, that one task compares on average."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    sample: int = 16384
    lists: int = 256
    rounds: int = 8
    first: int = 2
    block: int = 4096
    seed: int = 11


#: Squared lengths from here on could make sums inexact in double precision.
_EXACT = float(1 << 53)
_WIDE = 1 << 62


def _vectors(col: pa.Array) -> np.ndarray:
    """The arrays, all of one length, as a matrix of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers**2).sum(axis=1) - 2 * x @ centers.T


def _centers(x: np.ndarray, cfg: MiningConfig) -> np.ndarray:
    """k-means centres, neighbours next to each other along their widest direction."""
    few = np.unique(x, axis=0)
    centers = few[np.random.default_rng(cfg.seed).choice(len(few), min(cfg.lists, len(few)), replace=False)]
    for _ in range(cfg.rounds):
        near = _distances(x, centers).argmin(axis=1)
        used = np.unique(near)
        centers = np.stack([x[near == c].mean(axis=0) for c in used])
    middle = centers - centers.mean(axis=0)
    return centers[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


@dataclass(frozen=True)
class Lists:
    """Centres, radii and sizes of the inverted lists, and the group of lists that each belongs to."""

    centers: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    group: np.ndarray

    @staticmethod
    def of(centers: np.ndarray, radii: np.ndarray, sizes: np.ndarray, block: int) -> Lists:
        group, held = np.zeros(len(sizes), dtype=np.int32), 0
        for i in range(1, len(sizes)):
            held += sizes[i - 1]
            alone = held + sizes[i] > block
            group[i] = group[i - 1] + alone
            held = 0 if alone else held
        return Lists(centers, radii, sizes, group)

    def bounds(self, a: np.ndarray, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that a member of each list can have against each row of ``a``, rounding allowed for."""
        long = np.sqrt((a * a).sum(axis=1))[:, None]
        centers = self.centers[which]
        mid, wide = a @ centers.T, long * self.radii[which]
        wide = wide + 1e-6 + 1e-9 * (wide + long * np.sqrt((centers * centers).sum(axis=1)))
        return mid - wide, mid + wide

    def groups(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each row of ``a`` and each group the largest bound of its lists that can hold a score in the window, else -inf."""
        least, most = self.bounds(a)
        most[(most < low[:, None]) | (least > high[:, None]) | (self.sizes == 0)] = -np.inf
        return np.maximum.reduceat(most, np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]), axis=1)


def _best(score: np.ndarray, valid: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest valid scores that reach its ``kth``, ties to the first columns."""
    score = np.where(valid, score, -np.inf)
    cut = np.maximum(kth, np.partition(score, -k, axis=1)[:, -k]) if score.shape[1] > k else kth
    over = score > cut[:, None]
    tie = (score == cut[:, None]) & valid
    tie &= np.cumsum(tie, axis=1, dtype=np.int32) <= (k - over.sum(axis=1))[:, None]
    return np.nonzero(over | tie)


def _search(asks: dict[str, np.ndarray], rows: dict[str, np.ndarray], lists: Lists, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, row, score): the asks' k best among ``rows``, visited list by list in order of the upper bounds."""
    order = np.lexsort((rows["vec_id"], rows["list"]))
    present, starts = np.unique(rows["list"][order], return_index=True)
    ends = np.append(starts[1:], len(order))
    a, kth = asks["q"], asks["least"].astype(np.float64)
    least, most = lists.bounds(a, present)
    most[(most < asks["low"][:, None]) | (least > asks["high"][:, None])] = -np.inf
    turns = np.argsort(-most, axis=1, kind="stable")
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for turn in range(len(present)):
        at = turns[:, turn]
        bound = most[np.arange(len(a)), at]
        go = np.flatnonzero((bound > -np.inf) & (bound >= kth))
        if not len(go):
            break
        found = [best]
        for j in np.unique(at[go]):
            cols = order[starts[j] : ends[j]]
            x, ids, labels = rows["q"][cols], rows["vec_id"][cols], rows["label"][cols]
            mine = go[at[go] == j]
            for i in range(0, len(mine), 1024):
                some = mine[i : i + 1024]
                score = a[some] @ x.T
                valid = (labels == asks["label"][some, None]) == same
                valid &= (ids != asks["anchor_id"][some, None]) & (score >= asks["low"][some, None]) & (score <= asks["high"][some, None])
                r, c = _best(score, valid, k, kth[some])
                found.append((some[r], cols[c], score[r, c]))
        ask, row, score = (np.concatenate(z) for z in zip(*found, strict=True))
        sort = np.lexsort((rows["vec_id"][row], -score, ask))
        ask, row, score = ask[sort], row[sort], score[sort]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        best = ask[rank < k], row[rank < k], score[rank < k]
        full = rank == k - 1
        kth[ask[full]] = np.maximum(kth[ask[full]], score[full])
    return best


_ASKS = "anchor_id long, slot int, label long, q array<int>, low long, high long"
_FOUND = "anchor_id long, slot int, vec_id long, score long"


def _visits(asks: DataFrame, shared, cfg: MiningConfig, first: bool) -> DataFrame:
    """The asks, which have ``least`` (the kth score so far, or null), with the groups of lists that they visit in this round."""
    most_first = cfg.first

    def walk(batches):
        for rows in batches:
            a = _vectors(rows.column("q"))
            low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
            bound = shared.value.groups(a, low, high)
            turn = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
            least = rows.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            go = (bound > -np.inf) & ((turn < most_first) if first else (turn >= most_first) & ~(bound < least[:, None]))
            ask, group = np.nonzero(go)
            out = rows.take(pa.array(ask))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(group.astype(np.int32))], names=[*out.schema.names, "grp"])

    return asks.mapInArrow(walk, f"{_ASKS}, least long, grp int")


def _round(filed: DataFrame, asks: DataFrame, shared, cfg: MiningConfig, k: int, same: bool, scratch: Scratch, first: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score): what one round of visits finds; at most k a shard and ask."""
    visits = scratch.keep(_visits(asks, shared, cfg, first), "visits")
    many = filed.groupBy("grp").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("parts"))
    blocks = visits.groupBy("grp").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("blocks"))
    plan = F.broadcast(many.join(blocks, "grp"))  # one row a group of lists: at most cfg.lists
    place = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(plan, "grp").select("*", place("blocks", "anchor_id", "slot").alias("blk"), every("parts").alias("prt")).drop("parts", "blocks")
    right = filed.join(plan, "grp").select("grp", "vec_id", "label", "q", "list", place("parts", "vec_id").alias("prt"), every("blocks").alias("blk"))

    def compare(some: pa.Table, rows: pa.Table) -> pa.Table:
        ask = row = np.zeros(0, np.int64)
        score, pick = np.zeros(0), lambda t, c: t.column(c).to_numpy()
        if some.num_rows and rows.num_rows:
            asks = {c: pick(some, c) for c in ("anchor_id", "label", "low", "high")} | {"q": _vectors(some.column("q").combine_chunks()), "least": some.column("least").fill_null(-_WIDE).to_numpy()}
            have = {c: pick(rows, c) for c in ("vec_id", "label", "list")} | {"q": _vectors(rows.column("q").combine_chunks())}
            ask, row, score = _search(asks, have, shared.value, k, same)
        took, of = some.take(pa.array(ask)), rows.take(pa.array(row))
        return pa.table([took.column("anchor_id"), took.column("slot"), of.column("vec_id"), pa.array(score.astype(np.int64))], names=["anchor_id", "slot", "vec_id", "score"])

    keys = ("grp", "prt", "blk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(filed: DataFrame, asks: DataFrame, shared, cfg: MiningConfig, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """Each ask's k best rows, of its own label or of others, with their rank."""
    start = scratch.keep(_top(_round(filed, asks.withColumn("least", F.lit(None).cast("long")), shared, cfg, k, same, scratch, True), k), "first")
    kth = start.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("least"))
    rest = _round(filed, asks.join(kth, ["anchor_id", "slot"], "left"), shared, cfg, k, same, scratch, False)
    return _top(start.drop("rank").unionByName(rest), k)


def hard_negatives(vectors: DataFrame, is_anchor: F.Column, cfg: MiningConfig | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label (an integer); other columns are ignored. Scores are inner products of
    the components floor(cfg.scale * x). An anchor's positives are its cfg.positives best rows of the same label; for each,
    the cfg.negatives best rows of other labels whose score is between low and high hundredths of the positive's.
    Ties go to the smaller vec_id. Rows take no part if vec_id, label, vector or a component is null, if a component isn't
    finite, or if the vector is empty or not as long as most of the sample; a zero vector takes part with score 0. Rows that share a vec_id
    are one: that with the smallest label, then the smallest vector. An empty table, or an anchor without
    positives or negatives, gives no rows. A vector whose squared length, in whole components, reaches 2**53 is an
    error, for its scores couldn't be exact.
    """
    cfg = cfg or MiningConfig()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite
    rows = vectors.where(good).select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.x", "v.anchor")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cfg.sample).select("x").toArrow().column("x").combine_chunks()
    if not len(some):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes, counts = np.unique(some.value_lengths().to_numpy(), return_counts=True)
    dim, scale = int(sizes[counts.argmax()]), cfg.scale
    some = some.filter(pa.array(some.value_lengths().to_numpy() == dim))
    centers = spark.sparkContext.broadcast(_centers(np.floor(scale * _vectors(some)), cfg))  # cfg.lists rows

    def file(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = np.floor(scale * _vectors(batch.column("x")))
            if ((q * q).sum(axis=1) >= _EXACT).any():
                raise ValueError("a vector is too long for exact scores: its squared length, in whole components, reaches 2**53")
            gap = _distances(q, centers.value)
            near = gap.argmin(axis=1)
            far = np.sqrt(((q - centers.value[near]) ** 2).sum(axis=1))
            whole = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, dim, dtype=np.int32)), pa.array(q.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), whole, batch.column("anchor"), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "label", "q", "anchor", "list", "far"])

    filed = scratch.keep(rows.where(F.size("x") == dim).mapInArrow(file, "vec_id long, label long, q array<int>, anchor boolean, list int, far double"), "filed")
    held = filed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toArrow()  # one row a list
    sizes, radii = np.zeros(len(centers.value), dtype=np.int64), np.zeros(len(centers.value))
    sizes[held.column("list").to_numpy()], radii[held.column("list").to_numpy()] = held.column("n").to_numpy(), held.column("radius").to_numpy()
    lists = Lists.of(centers.value, radii, sizes, cfg.block)
    shared = spark.sparkContext.broadcast(lists)
    groups = spark.createDataFrame([(i, int(g)) for i, g in enumerate(lists.group)], "list int, grp int")
    filed = filed.join(F.broadcast(groups), "list")

    anchors = filed.where("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "q")
    asks = anchors.select("anchor_id", F.lit(0).alias("slot"), "label", "q", F.lit(-_WIDE).alias("low"), F.lit(_WIDE).alias("high"))
    positives = _nearest(filed, asks, shared, cfg, cfg.positives, True, scratch)
    positives = scratch.keep(positives.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    hundredth = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    p = F.col("positive_score")
    window = [(-hundredth(-cfg.low * p)).alias("low"), hundredth(cfg.high * p).alias("high")]  # low * p <= 100 * n <= high * p, for whole n
    asks = positives.join(anchors, "anchor_id").select("anchor_id", "slot", "label", "q", *window).where("low <= high")
    negatives = _nearest(filed, asks, shared, cfg, cfg.negatives, False, scratch)
    out = negatives.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
