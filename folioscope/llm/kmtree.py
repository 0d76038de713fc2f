"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is filed in the leaf that it descends to. Where leaves come out too
large, executors fit a subtree on a bounded sample of each, which takes the leaf's place. A query walks the tree best bin
first: a priority queue holds the branches not taken, nearest centre first. How many leaves a query visits is
widened until a bounded set of calibration queries, searched exactly against all rows, reaches the recall asked for.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import cosines, matrix, sample, unit


@dataclass(frozen=True)
class TreeConfig:
    """sample: rows that the tree is fitted on at most. leaf: sample rows in a leaf at most. rows: a leaf with more gets a subtree, fitted on ``sub`` of its rows at most. calibrate: calibration queries at most. block: rows of a leaf, and queries, that one task compares at most on average; larger leaves are split."""

    k: int = 5
    sample: int = 16384
    branch: int = 8
    leaf: int = 48
    rows: int = 1024
    sub: int = 4096
    rounds: int = 8
    calibrate: int = 200
    recall: float = 0.98
    block: int = 2048
    seed: int = 5


class Tree:
    """children[i]: nodes below node i; centers[i]: their centres; leaf[i]: number of the leaf, or -1."""

    def __init__(self, x: np.ndarray, cfg: TreeConfig):
        self.dim, self.children, self.centers, self.leaf, self.leaves = x.shape[1], [], [], [], 0
        self._grow(x, cfg, np.random.default_rng(cfg.seed))

    def _grow(self, x: np.ndarray, cfg: TreeConfig, rng: np.random.Generator) -> int:
        node = len(self.leaf)
        for part in (self.children, self.centers, self.leaf):
            part.append(None)
        groups, centers = self._split(x, cfg, rng) if len(x) > cfg.leaf else ([], None)
        if len(groups) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return node
        self.leaf[node], self.centers[node] = -1, centers
        self.children[node] = [self._grow(x[g], cfg, rng) for g in groups]
        return node

    @staticmethod
    def _split(x: np.ndarray, cfg: TreeConfig, rng: np.random.Generator):
        centers = x[rng.choice(len(x), min(cfg.branch, len(x)), replace=False)]
        for _ in range(cfg.rounds):
            near = _nearest(x, centers)
            used = np.unique(near)
            centers = np.stack([x[near == c].mean(axis=0) for c in used])
        near = _nearest(x, centers)
        used = np.unique(near)
        return [np.flatnonzero(near == c) for c in used], centers[used]

    def graft(self, below: dict[int, Tree]) -> None:
        """Puts a tree in the place of each leaf that is named, and numbers the leaves anew."""
        node_of = {leaf: node for node, leaf in enumerate(self.leaf) if leaf >= 0}
        for leaf, tree in below.items():
            shift = len(self.leaf) - 1  # the subtree's root is the leaf's node, the others follow at the end
            place = lambda n, node=node_of[leaf], shift=shift: n + shift if n else node
            self.leaf[node_of[leaf]], self.centers[node_of[leaf]] = tree.leaf[0], tree.centers[0]
            self.children[node_of[leaf]] = [place(c) for c in tree.children[0] or []]
            for n in range(1, len(tree.leaf)):
                self.leaf.append(tree.leaf[n])
                self.centers.append(tree.centers[n])
                self.children.append([place(c) for c in tree.children[n] or []])
        ends = [node for node, leaf in enumerate(self.leaf) if leaf >= 0]
        for number, node in enumerate(ends):
            self.leaf[node] = number
        self.leaves = len(ends)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = _nearest(x[rows], self.centers[node])
            todo += [(child, rows[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any()]
        return out

    def visit(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that query q visits, best bin first: ``most``, and more until they hold ``least`` of the leaves' ``rows``."""
        out, queue, have = [], [(0.0, 0)], 0
        while queue and (len(out) < most or have < least):
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                gap = ((self.centers[node] - q) ** 2).sum(axis=1)
                best = int(gap.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (float(gap[c]), child))
                node = self.children[node][best]
            out.append(self.leaf[node])
            have += 0 if rows is None else int(rows[out[-1]])
        return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the vector, cosine): each query's k nearest, ties to the smaller id, its own id left out."""
    rough = unit(q) @ unit(x).T
    rough[q_ids[:, None] == x_ids[None, :]] = -9
    if rough.shape[1] > k:
        least = np.partition(rough, -k, axis=1)[:, -k] - 1e-9
        i, j = np.nonzero((rough >= least[:, None]) & (rough > -8))
    else:
        i, j = np.nonzero(rough > -8)
    s = cosines(q[i], x[j])
    order = np.lexsort((x_ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], s[rank < k]


_FOUND = "query_id long, vec_id long, score double, leaf int"


def _arrow(ids: np.ndarray, others: np.ndarray, s: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(s, pa.float64()), pa.array(leaf, pa.int32())], names=["query_id", "vec_id", "score", "leaf"])


def _calibrated(filed: DataFrame, queries: DataFrame, tree: Tree, cfg: TreeConfig) -> int:
    """The number of leaves to visit."""
    rows = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cfg.calibrate).select("vec_id", "embedding").toArrow()
    pick, q = matrix(rows.column("embedding"), tree.dim) if rows.num_rows else ([], None)
    if not len(pick):
        return tree.leaves
    ids = rows.column("vec_id").to_numpy()[pick]
    dim, k = tree.dim, cfg.k

    def exact(batches):
        i = np.zeros(0, np.int64)
        best = (i, i, np.zeros(0), i)  # query, vector, score, leaf
        for rows in batches:
            pick, x = matrix(rows.column("embedding"), dim)
            if not len(pick):
                continue
            x_ids, leaf = (rows.column(c).to_numpy()[pick] for c in ("vec_id", "leaf"))
            a, b, s = _best(q, ids, x, x_ids, k)
            best = tuple(np.concatenate(z) for z in zip(best, (a, x_ids[b], s, leaf[b]), strict=True))
            order = np.lexsort((best[1], -best[2], best[0]))
            best = tuple(z[order] for z in best)
            keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = tuple(z[keep] for z in best)
        if len(best[0]):
            yield _arrow(ids[best[0]], best[1], best[2], best[3])

    found = _nearest_k(filed.mapInArrow(exact, _FOUND), k).select("query_id", "leaf").toArrow()
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves), 1)} for i, v in zip(ids, unit(q), strict=True)}
    need = np.sort([order[i][leaf] for i, leaf in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)])
    return int(need[min(len(need) - 1, int(np.ceil(cfg.recall * len(need))) - 1)]) if len(need) else tree.leaves


def _nearest_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _filed(vectors: DataFrame, tree: Tree, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, ask, leaf) of the vectors that take part, and how many each leaf holds."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(tree), tree.dim

    def file(batches):
        for rows in batches:
            pick, x = matrix(rows.column("embedding"), dim)
            rows = rows.take(pa.array(pick, pa.int64()))
            leaf = shared.value.file(unit(x)) if len(pick) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("vec_id", "embedding", "ask")), pa.array(leaf, pa.int32())], names=["vec_id", "embedding", "ask", "leaf"])

    kind = dict(vectors.dtypes)["embedding"]
    filed = scratch.keep(vectors.mapInArrow(file, f"vec_id long, embedding {kind}, ask boolean, leaf int"), "filed")
    counts = filed.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()  # one row a leaf
    held = np.zeros(tree.leaves, dtype=np.int64)
    held[counts.column("leaf").to_numpy()] = counts.column("n").to_numpy()
    return filed, held


def _subtrees(filed: DataFrame, held: np.ndarray, tree: Tree, cfg: TreeConfig) -> dict[int, Tree]:
    """A tree for each leaf with more than cfg.rows rows, fitted where its sample is; leaves whose rows can't be told apart have none."""
    large = np.flatnonzero(held > cfg.rows)
    if not len(large):
        return {}
    spark, dim = filed.sparkSession, tree.dim
    share = spark.createDataFrame([(int(leaf), int(held[leaf]), min(1.0, 1.5 * cfg.sub / int(held[leaf]))) for leaf in large], "leaf int, held long, share double")  # one row a leaf of the first tree
    hashed = F.xxhash64("vec_id", F.lit(1))
    order = Window.partitionBy("leaf").orderBy("hashed", "vec_id")
    some = filed.select("leaf", "vec_id", "embedding", hashed.alias("hashed")).join(F.broadcast(share), "leaf")
    some = some.where(F.pmod("hashed", F.lit(1 << 30)) < F.col("share") * (1 << 30)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cfg.sub).drop("n")

    def grow(rows: pa.Table) -> pa.Table:
        x = unit(matrix(rows.column("embedding"), dim)[1])
        leaf, many = rows.column("leaf")[0].as_py(), rows.column("held")[0].as_py()
        own = replace(cfg, leaf=max(min(cfg.leaf, 32), -(-len(x) * cfg.rows // (4 * many))))
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(Tree(x, own))], pa.binary())})

    rows = some.groupBy("leaf").applyInArrow(grow, "leaf int, tree binary").collect()
    grown = {r["leaf"]: pickle.loads(bytes(r["tree"])) for r in rows}
    return {leaf: t for leaf, t in sorted(grown.items()) if t.leaves > 1}


def neighbours(vectors: DataFrame, is_query: F.Column, cfg: TreeConfig | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows that ``is_query`` picks, their cfg.k nearest by cosine.

    ``vectors`` has vec_id and embedding; other columns are ignored. Vectors that are null, zero, of another length than
    the commonest of the sample, or that hold null or non-finite components take no part on either side, nor do rows
    without a vec_id. Rows that share a vec_id are one, with the smallest of their vectors that are whole; it is a query if one of
    them is. Ties go to the smaller vec_id; a query's own vec_id is no candidate. An empty table gives no rows.
    """
    cfg = cfg or TreeConfig()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kmtree")
    number = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = number & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable).select(F.col("vec_id").cast("long"), "embedding", F.coalesce(is_query, F.lit(False)).alias("ask"))
    vectors = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("ask").alias("ask"))
    tree = Tree(sample(vectors, cfg.sample), cfg)
    k, dim = cfg.k, tree.dim
    filed, held = _filed(vectors, tree, scratch)
    if below := _subtrees(filed, held, tree, cfg):
        tree.graft(below)
        old = filed
        filed, held = _filed(old.drop("leaf"), tree, scratch)
        scratch.drop(old)
    shared = spark.sparkContext.broadcast(tree)  # bounded by cfg.sample and, a leaf of that, cfg.sub
    kind = dict(vectors.dtypes)["embedding"]
    queries = filed.where("ask")
    most = _calibrated(filed, queries, tree, cfg)
    held = spark.sparkContext.broadcast(held)

    def walk(batches):
        for rows in batches:
            pick, q = matrix(rows.column("embedding"), dim)
            for at in range(0, len(pick), 50):
                some = [shared.value.visit(v, most, held.value, k + 1) for v in unit(q[at : at + 50])]
                out = rows.take(pa.array(np.repeat(pick[at : at + 50], [len(x) for x in some]), pa.int64()))
                yield pa.RecordBatch.from_arrays([out.column("vec_id"), out.column("embedding"), pa.array(np.concatenate(some), pa.int32())], names=["query_id", "asked", "leaf"])

    visits = scratch.keep(queries.mapInArrow(walk, f"query_id long, asked {kind}, leaf int"), "visits")
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias(name))
    plan = F.broadcast(blocks(filed, "nv").join(blocks(visits, "nq"), "leaf"))  # one row a leaf: bounded by cfg.sample
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(plan, "leaf").select("leaf", "query_id", "asked", place("query_id", "nq").alias("qb"), every("nv").alias("vb"))
    right = filed.join(plan, "leaf").select("leaf", "vec_id", "embedding", place("vec_id", "nv").alias("vb"), every("nq").alias("qb"))

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        a_ids = x_ids = np.zeros(0, np.int64)
        if asked.num_rows and rows.num_rows:
            (a, q), (b, x) = matrix(asked.column("asked"), dim), matrix(rows.column("embedding"), dim)
            a_ids, x_ids = asked.column("query_id").to_numpy()[a], rows.column("vec_id").to_numpy()[b]
            i, j, s = _best(q, a_ids, x, x_ids, k)
        return pa.Table.from_batches([_arrow(a_ids[i], x_ids[j], s, np.zeros(len(i), np.int32))])

    keys = ("leaf", "vb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, _FOUND)
    return _nearest_k(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
