"""Near-duplicate vectors with a forest of random-projection trees.

Each tree splits recursively at the median of a random projection; vectors near a split spill to both sides. All pairs
within a leaf are compared, those at or above the threshold link, and the links' components are formed.

A pair may share leaves in several trees; it counts in the first of them only, so a leaf's task can report sums and a
spanning forest of its links instead of the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .components import components
from .vectors import cosines, matrix, sample, unit


@dataclass(frozen=True)
class ForestConfig:
    """sample: rows that the splits are fitted on at most. rows: vectors in a leaf, about. spill: half the width of the overlap, in standard deviations of a projected unit vector. block: vectors of a leaf that one task compares at most on average with as many others."""

    threshold: float = 0.9
    trees: int = 4
    sample: int = 32768
    rows: int = 512
    spill: float = 0.25
    block: int = 2048
    seed: int = 3


class ProjectionTree:
    def __init__(self, x: np.ndarray, least: int, spill: float, rng: np.random.Generator):
        self.spill, self.leaves = spill / np.sqrt(max(x.shape[1], 1)), 0
        self.nodes: list[tuple] = []
        self._grow(x, max(least, 2), rng)

    def _grow(self, x: np.ndarray, least: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        way = rng.normal(size=x.shape[1])
        way /= np.sqrt((way**2).sum()) or 1
        p = x @ way
        cut = float(np.median(p)) if len(p) else 0.0
        low = p <= cut
        if len(x) <= least or low.all() or np.ptp(p) <= 4 * self.spill:
            self.nodes[at] = (self.leaves,)
            self.leaves += 1
        else:
            self.nodes[at] = (way, cut, self._grow(x[low], least, rng), self._grow(x[~low], least, rng))
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a row falls in."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, some = todo.pop()
            if not len(some):
                continue
            if len(self.nodes[node]) == 1:
                rows.append(some)
                leaves.append(np.full(len(some), self.nodes[node][0]))
                continue
            way, cut, low, high = self.nodes[node]
            p = x[some] @ way
            todo += [(low, some[p <= cut + self.spill]), (high, some[p >= cut - self.spill])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest code that both rows hold, pair by pair; codes ascend and are padded with -1."""
    out = np.full(len(a), np.iinfo(np.int32).max, dtype=np.int32)
    for i in range(a.shape[1]):
        x = a[:, i]
        hit = (x >= 0) & (x < out) & (b == x[:, None]).any(axis=1)
        out[hit] = x[hit]
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_vectors(vectors: DataFrame, cfg: ForestConfig | None = None) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included), kept.

    ``vectors`` has vec_id and embedding; other columns are ignored. One row comes out for each row with a vec_id.
    Vectors that are null, zero, of another length than the commonest of the sample, or that hold null or non-finite
    components link with nothing. Equal vectors are one node, and count as links of one another. An empty table gives no rows.
    """
    cfg = cfg or ForestConfig()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "rpforest")
    vectors = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding")
    kind = dict(vectors.dtypes)["embedding"]
    x = sample(vectors, cfg.sample)
    dim, rng = x.shape[1], np.random.default_rng(cfg.seed)

    def prints(batches):
        for rows in batches:
            pick, x = matrix(rows.column("embedding"), dim)
            out = np.full(len(rows), None, dtype=object)
            out[pick] = [xxhash.xxh3_128_digest(v.tobytes()) for v in x + 0.0]
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(out.tolist(), pa.binary())], names=["vec_id", "print"])

    each = scratch.keep(vectors.mapInArrow(prints, "vec_id long, print binary"), "prints")
    classes = scratch.keep(each.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    reps = vectors.join(classes.select(F.col("rep").alias("vec_id"), "many"), "vec_id").dropDuplicates(["vec_id"])
    many = max(classes.count(), 1)
    least = max(2, int(len(x) * cfg.rows / many))  # cfg.sample / 2 leaves at most; larger leaves are compared block by block
    forest = [ProjectionTree(x, least, cfg.spill, rng) for _ in range(cfg.trees)]
    first = np.concatenate([[0], np.cumsum([t.leaves for t in forest])]).astype(np.int64)
    shared = spark.sparkContext.broadcast(forest)  # bounded by cfg.sample

    def route(batches):
        for rows in slices(batches, 250):
            pick, x = matrix(rows.column("embedding"), dim)
            if not len(pick):
                continue
            at, codes = (np.concatenate(z) for z in zip(*((r, c + f) for t, f in zip(shared.value, first, strict=False) for r, c in [t.route(unit(x))]), strict=True))
            order = np.lexsort((codes, at))
            at, codes = at[order], codes[order].astype(np.int32)
            ends = np.searchsorted(at, np.arange(len(pick) + 1)).astype(np.int32)
            held = pa.ListArray.from_arrays(ends, codes).take(pa.array(at))
            out = rows.take(pa.array(pick[at]))
            yield pa.RecordBatch.from_arrays([pa.array(codes), held, *(out.column(c) for c in ("vec_id", "many", "embedding"))], names=["code", "codes", "vec_id", "many", "embedding"])

    routed = scratch.keep(reps.select("vec_id", "many", "embedding").mapInArrow(route, f"code int, codes array<int>, vec_id long, many long, embedding {kind}"), "routed")
    plan = F.broadcast(routed.groupBy("code").agg(F.ceil(F.count("*") / cfg.block).cast("int").alias("n")))  # one row a leaf
    own = F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int").alias("own")
    meet = routed.join(plan, "code").select("code", "codes", "vec_id", "many", "embedding", "n", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "other")
    threshold = cfg.threshold

    def compare(rows: pa.Table) -> pa.Table:
        code, lo, hi = (rows.column(c)[0].as_py() for c in ("code", "lo", "hi"))
        ids, many, own = (rows.column(c).to_numpy() for c in ("vec_id", "many", "own"))
        x = matrix(rows.column("embedding"), dim)[1]
        held = rows.column("codes").combine_chunks()
        size = held.value_lengths().to_numpy(zero_copy_only=False)
        wide = np.full((len(ids), int(size.max())), -1, dtype=np.int32)
        wide[np.repeat(np.arange(len(ids)), size), np.concatenate([np.arange(n) for n in size])] = held.flatten().to_numpy(zero_copy_only=False)
        near = unit(x)
        links, ends = np.zeros(len(ids), dtype=np.int64), []
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for at in range(0, len(a), 512):
            some = a[at : at + 512]
            i, j = np.nonzero(near[some] @ near[b].T >= threshold - 1e-9)
            i, j = some[i], b[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            good = np.concatenate([np.zeros(0, bool), *(cosines(x[i[k : k + 20000]], x[j[k : k + 20000]]) >= threshold for k in range(0, len(i), 20000))])
            i, j = i[good], j[good]
            mine = np.concatenate([np.zeros(0, bool), *(_first_shared(wide[i[k : k + 20000]], wide[j[k : k + 20000]]) == code for k in range(0, len(i), 20000))])
            i, j = i[mine], j[mine]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            ends.append((i, j))
        i, j = (np.concatenate(z) for z in zip(*ends, strict=True)) if ends else (a[:0], a[:0])
        root = ids[_roots(len(ids), i, j)]
        keep = links > 0
        return pa.table({"vec_id": ids[keep], "links": links[keep], "root": root[keep]})

    found = scratch.keep(meet.groupBy("code", "lo", "hi").applyInArrow(compare, "vec_id long, links long, root long"), "found")
    named = components(spark, found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), scratch)
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    classes = classes.join(links, "rep", "left").join(named.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("print", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = each.join(classes, "print", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
