"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``m`` sub-sketches of ``r`` minhashes each give m * m tables: the key of table (i, j) is the pair of
sub-sketch i of the first and j of the second collection. A document so computes 2 * m * r minhashes where m * m
independent tables of 2 * r rows would take m * m * 2 * r. Two sets of similarity s meet in a table with the
probability (1 - (1 - s ** r) ** m) ** 2.

Every pair that meets is verified on the full shingle sets before it links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_by, mix, slices, text_steps, word_hashes, word_spans
from .components import components

_FOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class MinHashConfig:
    """width: words in a shingle. A pair links if 100 * |A & B| >= percent * |A | B|. m, r: see the module. slack: a pair whose sketches agree in fewer than this share of minhashes isn't verified (six standard deviations below 0.8). rare: documents of a family that may have a shingle for it to propose pairs."""

    width: int = 5
    percent: int = 80
    m: int = 10
    r: int = 3
    slack: float = 0.5
    rare: int = 8
    seed: int = 7

    @property
    def hashes(self) -> int:
        return 2 * self.m * self.r


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of one document's word hashes; of fewer than ``width`` words, the whole sequence is one."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    acc = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = mix(acc * _FOLD + words[i : n - k + 1 + i])
    return np.unique(acc)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for rows, buf, offs in text_steps(batches):
        starts, ends, ptr = word_spans(buf, offs)
        words = word_hashes(buf, starts, ends, lower=True)
        yield rows, [shingle_set(words[a:b], width) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


def _sketcher(cfg: MinHashConfig):
    rng = np.random.default_rng(cfg.seed)
    flip, times = (rng.integers(1, 1 << 63, cfg.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def sketch(items: np.ndarray) -> np.ndarray:
        least = np.full(cfg.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(items), 1024):
            x = items[i : i + 1024, None] ^ flip
            x *= times
            np.minimum(least, x.min(axis=0), out=least)
        return least

    return sketch


_SLOTS = 256

_SKETCHES = "doc_id long, n_shingles long, print binary, a array<long>, b array<long>, sketch binary"


def sketches(docs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """doc_id, size and fingerprint of the shingle set, its two collections of sub-sketches, and a byte of each minhash. Empty sets have a null fingerprint."""

    def run(batches):
        sketch = _sketcher(cfg)
        for rows, sets in _sets(batches, cfg.width):
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            least = np.stack([sketch(s) for s in sets])
            parts = least.reshape(len(sets), 2 * cfg.m, cfg.r)
            keys = np.full(parts.shape[:2], cfg.seed, dtype=np.uint64)
            for i in range(cfg.r):
                keys = mix(keys * _FOLD + parts[:, :, i])
            lists = [pa.ListArray.from_arrays(np.arange(0, len(sets) * cfg.m + 1, cfg.m, dtype=np.int32), np.ascontiguousarray(keys[:, k : k + cfg.m]).view(np.int64).ravel()) for k in (0, cfg.m)]
            low = mix(least).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), *lists, pa.array([x.tobytes() for x in low], pa.binary())], names=["doc_id", "n_shingles", "print", "a", "b", "sketch"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, _SKETCHES)


def _table_keys(cfg: MinHashConfig):
    """Arrow (a, b) lists -> the m * m keys of each row."""
    place = mix(np.arange(1, cfg.m * cfg.m + 1, dtype=np.uint64)).reshape(cfg.m, cfg.m)

    def keys(rows: pa.RecordBatch) -> np.ndarray:
        a, b = (rows.column(c).flatten().to_numpy().view(np.uint64).reshape(len(rows), cfg.m) for c in "ab")
        return mix((a[:, :, None] * _FOLD + b[:, None, :]) ^ place).reshape(len(rows), -1)

    return keys


def _meetings(reps: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """(u, v), repeated: each member of a table entry with the smallest member.

    A task first joins its own members of an entry to the smallest of them and sends that one only, so that an entry gets
    one row a task however many members it has.
    """

    def local(batches):
        keys = _table_keys(cfg)
        for rows in batches:
            k, ids = keys(rows), rows.column("doc_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            k, ids = k[order].ravel(), np.repeat(ids[order], k.shape[1])
            at = np.argsort(k, kind="stable")
            k, ids = k[at], ids[at]
            new = np.ones(len(k), dtype=bool)
            new[1:] = k[1:] != k[:-1]
            hub = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(new, k, mix(ids.astype(np.uint64) ^ k)).view(np.int64)), pa.array(ids), pa.array(np.where(new, -1, hub), mask=new)], names=["key", "id", "hub"])

    rows = reps.select("doc_id", "a", "b").mapInArrow(local, "key long, id long, hub long")
    least = F.min(F.when(F.col("hub").isNull(), F.col("id"))).over(_by_key())
    return rows.withColumn("least", least).select(F.coalesce("hub", "least").alias("u"), F.col("id").alias("v")).where("u < v")


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key")


def _rarities(sets: DataFrame, family: DataFrame, each: DataFrame, cfg: MinHashConfig, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, family, n, s, core, spread) and (id, family, item, df).

    s: how many of a document's shingles another document of its family has; core: how many more than cfg.rare documents
    of its family have. The second table has the other shared shingles. No pair has more in common than the smaller s;
    a pair without a rare shingle in common has no more in common than the smaller core. spread: how many shingles fall
    in each of some slots; slot by slot, a pair has no more in common than the smaller count.
    """

    def explode(batches):
        for rows in slices(batches, 100):
            items = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in rows.column("items")]
            many = [len(x) for x in items]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(rows.column(c).to_numpy(), many)) for c in ("id", "family")), pa.array(np.concatenate(items))], names=["id", "family", "item"])

    def spread(batches):
        for rows in slices(batches, 100):
            items = [np.frombuffer(x.as_buffer(), dtype=np.uint64) % np.uint64(_SLOTS) for x in rows.column("items")]
            counts = np.concatenate([np.bincount(x.astype(np.int64), minlength=_SLOTS) for x in items]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(np.arange(0, len(counts) + 1, _SLOTS, dtype=np.int32), counts)], names=["id", "spread"])

    items = scratch.keep(sets.join(family, "id").mapInArrow(explode, "id long, family long, item long"), "items")
    few = items.groupBy("family", "item").agg(F.count("*").alias("df")).where(F.col("df") <= cfg.rare)
    few = scratch.keep(items.join(few, ["family", "item"]), "few")
    counts = few.groupBy("id").agg(F.count_if(F.col("df") == 1).alias("alone"), F.count("*").alias("few"))
    sizes = each.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")).distinct()
    counts = family.join(sizes, "id").join(counts, "id", "left").select("id", "family", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"), (F.col("n") - F.coalesce("few", F.lit(0))).alias("core"))
    spreads = sets.join(family, "id").select("id", "items").mapInArrow(spread, "id long, spread array<int>")
    counts = scratch.keep(counts.where(F.col("s") * 100 >= F.col("n") * cfg.percent).join(spreads, "id"), "counts")
    scratch.drop(items)
    return counts, few.where("df > 1")


def _across(named: DataFrame, counts: DataFrame, few: DataFrame, apart: DataFrame, cfg: MinHashConfig, scratch: Scratch) -> DataFrame:
    """(u, v), repeated: pairs of a family in different components, one of them a component that ``apart`` touches, that may have the similarity.

    Sets of x and y shingles with the similarity have at least percent / (100 + percent) * (x + y) in common. So a pair
    either has a rare shingle in common, which pairs each document with fewer than cfg.rare others, or core shingles
    enough, which bounds the partner's size: documents join on family and steps of size.
    """
    p = cfg.percent
    touched = apart.select(F.col("u").alias("id")).unionByName(apart.select(F.col("v").alias("id"))).distinct().withColumn("end", F.lit(1))
    sizes = scratch.keep(named.join(touched, "id", "left").groupBy("component").agg(F.count("*").alias("many"), F.max("end").isNotNull().alias("ends")), "sizes")
    able = scratch.keep(join_by(counts.join(named, "id"), sizes, "component", "many", named.count()), "able")
    other = {"id": "x", "component": "cx", "many": "mx", "n": "nx"}
    # Of two components the smaller one looks for partners in the larger.
    toward = (F.col("mx") < F.col("many")) | ((F.col("mx") == F.col("many")) & (F.col("cx") < F.col("component")))
    pair = lambda df: df.select(F.least("x", "id").alias("u"), F.greatest("x", "id").alias("v"))
    step = lambda c: F.floor(F.log(c) / 0.02).cast("int")
    members = able.where(F.col("core") * 100 >= F.col("n") * p).select("family", "id", "component", "many", "ends", "n", "core", "spread", step(F.col("n")).alias("step"))
    least, most = F.ceil(F.col("n") * p / 100), F.least(F.floor(F.col("core") * (100 + p) / p) - F.col("n"), F.floor(F.col("n") * 100 / p))
    some = members.where("ends").where(most >= least).select("family", *(F.col(k).alias(v) for k, v in other.items()), F.col("core").alias("corex"), F.col("spread").alias("spreadx"), F.explode(F.sequence(step(least), step(most))).alias("step"))
    enough = toward & ((100 + p) * F.least("core", "corex") >= p * (F.col("n") + F.col("nx")))
    slots = F.aggregate(F.zip_with("spread", "spreadx", lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    enough &= (100 + p) * slots >= p * (F.col("n") + F.col("nx"))
    common = pair(some.join(members.drop("ends"), ["family", "step"]).where(enough))
    rows = few.join(able.select("id", "component", "many", "ends", "n"), "id").select("family", "item", "id", "component", "many", "ends", "n")
    some = rows.where("ends").select("family", "item", *(F.col(k).alias(v) for k, v in other.items()))
    near = toward & (F.least("n", "nx") * 100 >= F.greatest("n", "nx") * p)
    return common.unionByName(pair(some.join(rows.drop("ends"), ["family", "item"]).where(near)))


def _likely(pairs: DataFrame, reps: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The distinct pairs whose sizes and sketches allow the similarity."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def close(batches):
        for rows in batches:
            x, y = (np.frombuffer(rows.column(c).combine_chunks().buffers()[2] if isinstance(rows.column(c), pa.ChunkedArray) else b"".join(rows.column(c).to_pylist()), dtype=np.uint8).reshape(len(rows), -1) for c in ("s_u", "s_v"))
            yield rows.select(["u", "v"]).filter(pa.array((x == y).sum(axis=1) >= cfg.slack * cfg.hashes))

    size = (F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * cfg.percent)
    return pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(size).mapInArrow(close, "u long, v long")


def _set_table(ids: DataFrame, docs: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """(id, items): the full shingle sets of some documents."""

    def full(batches):
        for rows, sets in _sets(batches, cfg.width):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"])

    return docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").mapInArrow(full, "id long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The pairs with the similarity, judged on the full shingle sets."""

    def judge(batches):
        for rows in batches:
            keep = []
            for x, y in zip(rows.column("x"), rows.column("y"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= cfg.percent * (len(x) + len(y) - both))
            yield rows.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").mapInArrow(judge, "u long, v long")


def near_duplicates(docs: DataFrame, cfg: MinHashConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names. One row comes out for each row that
    goes in. Null and wordless texts have no shingles and link with nothing. Rows without a doc_id can't be named in a
    result and are left out. Rows with the same shingle set are one node, so copies cost nothing; a doc_id that stands
    on several rows is one node as well. An empty table gives no rows.
    """
    cfg = cfg or MinHashConfig()
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    each = scratch.keep(sketches(docs, cfg), "sketches")
    classes = each.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    reps = scratch.keep(each.join(classes, (each["print"] == classes["print"]) & (each["doc_id"] == classes["rep"]), "left_semi").drop("print"), "reps")
    meetings = scratch.keep(_meetings(reps, cfg).distinct(), "meetings")
    pairs = scratch.keep(_likely(meetings, reps, cfg), "pairs")
    met = scratch.keep(meetings.select(F.col("u").alias("id")).unionByName(meetings.select(F.col("v").alias("id"))).distinct(), "met")
    sets = scratch.keep(_set_table(met, docs, cfg), "sets")
    links = scratch.keep(_verified(pairs, sets, cfg), "links")
    named = components(spark, links, scratch)
    # Members of an entry that its smallest member doesn't link, or isn't even likely to, may link among themselves.
    label = lambda c: named.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    # All other meetings are inside a component, so families are found over components instead of documents.
    ends = F.coalesce("c_u", "u").alias("a"), F.coalesce("c_v", "v").alias("b")
    apart = scratch.keep(meetings.join(label("u"), "u", "left").join(label("v"), "v", "left").select("u", "v", *ends).where("a <> b"), "apart")
    families = components(spark, apart.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).toDF("component", "family")
    now = scratch.keep(met.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "now")
    sizes = scratch.keep(now.groupBy("component").agg(F.count("*").alias("many")).join(families, "component"), "sizes")
    open_ = scratch.keep(join_by(now, sizes, "component", "many", now.count()).select("id", "family"), "open")
    counts, few = _rarities(sets, open_, each, cfg, scratch)
    more = _across(now, counts, few, apart, cfg, scratch).distinct().join(meetings, ["u", "v"], "left_anti")
    more = scratch.keep(_likely(more, reps, cfg), "more")
    stars = named.select(F.col("component").alias("u"), F.col("id").alias("v"))
    named = components(spark, stars.unionByName(_verified(more, sets, cfg)), scratch)
    owner = each.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    out = owner.join(named, owner["rep"] == named["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
