"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Documents are dealt to shards of bounded size by the hash of doc_id. In a shard, longest first, each goes to the open bin
with the least room that still holds it and doesn't conflict with it: bins stand by room left, and the search goes from
one room to the next larger one until the tightest compatible bin is found, of equal rooms the bin that came to it first;
if there is none, a bin is opened.

A bin carries bitmaps over the shard's duplicate clusters and sources. It takes no second document of a cluster, and at
most cfg.per_source documents of a source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .unigram import token_counts


@dataclass(frozen=True)
class PackingConfig:
    """capacity: tokens of a bin. shard: documents that one task packs, about."""

    capacity: int = 4096
    per_source: int = 4
    shard: int = 2500


class Bins:
    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some bin has room r
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # bitmap k: sources with more than k documents in the bin

    def put(self, size: int, cluster: int, source: int) -> int:
        """``cluster``, ``source``: one bit each, or 0 where nothing can conflict."""
        rooms = self.rooms >> size
        room = size
        while rooms:
            skip = (rooms & -rooms).bit_length() - 1
            room += skip
            for place, b in enumerate(self.by_room[room]):
                if not (self.clusters[b] & cluster or self.sources[b][-1] & source):
                    del self.by_room[room][place]
                    if not self.by_room[room]:
                        self.rooms &= ~(1 << room)
                    return self._enter(b, room, size, cluster, source)
            rooms >>= skip + 1
            room += 1
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        return self._enter(len(self.clusters) - 1, self.capacity, size, cluster, source)

    def _enter(self, b: int, room: int, size: int, cluster: int, source: int) -> int:
        self.clusters[b] |= cluster
        for k, held in enumerate(self.sources[b]):
            if not held & source:
                self.sources[b][k] |= source
                break
        self.by_room[room - size].append(b)
        self.rooms |= 1 << (room - size)
        return b


def _bits(values: list, least: int) -> list[int]:
    """A bit for each value that ``least`` rows or more have; 0 for the others and for nulls."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    bit = {v: 1 << k for k, v in enumerate(v for v, n in seen.items() if v is not None and n >= least)}
    return [bit.get(v, 0) for v in values]


def pack(items: DataFrame, cfg: PackingConfig | None = None) -> DataFrame:
    """doc_id, part, start, n_tokens, bin_id, slot (place in the bin, from 0), used (tokens in the bin).

    ``items`` has doc_id, n_tokens (null or less than 1 counts as 1), source and cluster; other columns are ignored.
    A document longer than the capacity falls into parts; all but the last fill a bin each. Null sources and clusters
    conflict with nothing. Rows without a doc_id are left out; repeated rows are packed each. An empty table gives no rows.
    The same rows give the same bins.
    """
    cfg = cfg or PackingConfig()
    scratch = Scratch(items.sparkSession, "packing")
    size = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(1)), F.lit(1))
    items = items.where("doc_id is not null").select(F.col("doc_id").cast("long"), size.alias("size"), F.col("source").cast("string"), F.col("cluster").cast("long"))
    items = scratch.keep(items, "items")  # counting tokens costs more than packing, so it runs once
    shards = max(1, -(-items.count() // cfg.shard))
    capacity, per_source = cfg.capacity, cfg.per_source
    part = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)).alias("part")
    items = items.select("doc_id", "size", "source", "cluster", part)
    start = F.col("part").cast("long") * capacity
    items = items.select("doc_id", "part", start.alias("start"), F.least(F.col("size") - start, F.lit(capacity).cast("long")).alias("n_tokens"), "source", "cluster", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        sizes = table.column("n_tokens").to_numpy()
        bins = Bins(capacity, per_source)
        at = np.array([bins.put(*x) for x in zip(sizes.tolist(), _bits(table.column("cluster").to_pylist(), 2), _bits(table.column("source").to_pylist(), per_source + 1), strict=True)], dtype=np.int64)
        order = np.argsort(at, kind="stable")
        slot = np.empty(len(at), dtype=np.int64)
        slot[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        used = np.bincount(at, weights=sizes).astype(np.int64)
        shard = table.column("shard")[0].as_py()
        return pa.table([*(table.column(c) for c in ("doc_id", "part", "start", "n_tokens")), pa.array(at + (shard << 32)), pa.array(slot), pa.array(used[at])], names=["doc_id", "part", "start", "n_tokens", "bin_id", "slot", "used"])

    return items.groupBy("shard").applyInArrow(fill, "doc_id long, part int, start long, n_tokens long, bin_id long, slot long, used long")


def items(docs: DataFrame, model: str, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, source, cluster, of doc_id, text and source: tokens are those of the unigram ``model`` and an end mark.

    cluster: component_id of ``clusters`` (doc_id, component_id), as near-dedup gives it; without them the hash of the
    text in lower case. Null texts have no cluster.
    """
    own = F.when(F.col("text").isNotNull(), F.xxhash64(F.lower("text"))).alias("cluster")
    counted = token_counts(docs.select("doc_id", "text", "source", own), model, "source", "cluster")
    counted = counted.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"), "source", "cluster")
    if clusters is None:
        return counted
    return counted.drop("cluster").join(clusters.select("doc_id", F.col("component_id").alias("cluster")).distinct(), "doc_id", "left")
