"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

Suffixes start at anchors: of every string of ``length`` bytes, the anchor is the leftmost smallest of the grams that
start in its first ``window`` bytes. Equal strings have their anchor at the same place, so only anchors need be indexed.

A batch's suffix array has its anchors' suffixes in order, each suffix by the names (64-bit hashes) of the two blocks
that every string of the anchor contains. A new batch is merge-scanned against the arrays of all levels for matches over
both blocks; arrays of equal size then merge, so that n batches make at most log2(n) + 1 levels.

Anchors with a match are settled exactly: first the whole reach of an anchor (all its strings together) is compared by
128-bit hash, then, where reaches with the same blocks differ, string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, Scratch, mix, partitions, prepare, text_steps


@dataclass(frozen=True)
class SuffixConfig:
    """length: bytes of a string that may not repeat. window: most bytes between anchors. gram: bytes whose hash picks an anchor. batches: in how many batches the documents join the index. shard: different reaches that one task compares, about; names with more than half of that are settled by their strings' hashes instead."""

    length: int = 400
    window: int = 160
    gram: int = 24
    batches: int = 4
    shard: int = 16384

    @property
    def block(self) -> int:
        return (self.length - self.window + 1) // 2


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_VALUES = [np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (41, 43)]
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _TABLES or len(_TABLES[which][0]) < n:
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            table = np.full(n, base, dtype=np.uint64)
            table[:1] = 1
            both.append(np.multiply.accumulate(table))
        _TABLES[which] = tuple(both)
    return _TABLES[which]


class Prefix:
    """Polynomial prefix sums of some bytes: the hash of any range in constant time."""

    def __init__(self, buf: np.ndarray, which: int):
        power, self.inverse = _powers(which, max(len(buf) + 1, STEP_BYTES + 4096))
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[which][buf] * power[: len(buf)], out=self.sums[1:])

    def __call__(self, x, y) -> np.ndarray:
        return mix((self.sums[y] - self.sums[x]) * self.inverse[x])


def range_hashes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, both: bool = True) -> np.ndarray:
    """Two independent 64-bit hashes (the first only, unless ``both``) of each range buf[x:y]; x ascends."""
    out = np.empty((1 + both, len(x)), dtype=np.uint64)
    i = 0
    while i < len(x):
        j = int(np.searchsorted(x, x[i] + STEP_BYTES, side="right"))
        lo, hi = int(x[i]), int(y[i:j].max())
        for k in range(1 + both):
            out[k, i:j] = Prefix(buf[lo:hi], k)(x[i:j] - lo, y[i:j] - lo)
        i = j
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(buf: np.ndarray, offs: np.ndarray, cfg: SuffixConfig) -> tuple[np.ndarray, ...]:
    """(anchor, first and last string start that it serves, names of its two blocks), over texts laid end to end at ``offs``."""
    parts = []
    index = np.uint64((1 << 22) - 1)
    for s0 in range(0, len(buf) - cfg.length + 1, STEP_BYTES):
        s1 = min(s0 + STEP_BYTES, len(buf) - cfg.length + 1)
        start = np.arange(s0, s1)
        ends = offs[np.searchsorted(offs, start, side="right")]
        whole = start + cfg.length <= ends
        if not whole.any():
            continue
        seg = Prefix(buf[s0 : s1 - 1 + cfg.length], 0)
        at = np.arange(s1 - s0 + cfg.window - 1)
        grams = seg(at, at + cfg.gram) & ~index | at.astype(np.uint64)
        pick = (_sliding_least(grams, cfg.window) & index).astype(np.int64)[whole]
        start = start[whole]
        new = np.ones(len(pick), dtype=bool)
        new[1:] = (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pick)) - 1
        a = pick[first]
        parts.append((a + s0, start[first], start[last], seg(a, a + cfg.block), seg(a + cfg.block, a + 2 * cfg.block)))
    if not parts:
        return (*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    a, lo, hi, k1, k2 = (np.concatenate(z) for z in zip(*parts, strict=True))
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (lo[1:] != hi[:-1] + 1)  # an anchor that two steps share is one
    ends = np.append(np.flatnonzero(keep)[1:], len(a)) - 1
    return a[keep], lo[keep], hi[ends], k1[keep], k2[keep]


class SuffixLevels:
    """The index family: tables of (k1, k2, n), bucketed and sorted by the names, at most one of each size class."""

    def __init__(self, spark: SparkSession, scratch: Scratch):
        self.spark, self.scratch, self.levels = spark, scratch, []
        self.buckets = partitions(spark)

    def _write(self, df: DataFrame) -> str:
        return self.scratch.bucketed(df, "level", self.buckets, "k1", "k2")

    def add(self, suffixes: DataFrame) -> list[DataFrame]:
        """Takes a batch (k1, k2, one row an anchor) in; returns the names that match: within the batch, and with each level."""
        new = self._write(suffixes.groupBy("k1", "k2").agg(F.count("*").alias("n")))
        table = self.spark.table(new)
        found = [table.where("n > 1").select("k1", "k2")]
        found += [table.select("k1", "k2").join(self.spark.table(level).select("k1", "k2"), ["k1", "k2"]) for _, level in self.levels]
        found = [self.scratch.keep(x, "matches") for x in found]
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, old = self.levels.pop()
            a, b = self.spark.table(new).withColumnRenamed("n", "m"), self.spark.table(old)
            both = self._write(a.join(b, ["k1", "k2"], "full_outer").select("k1", "k2", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n")))
            for gone in (new, old):
                self.scratch.drop_table(gone)
            new, rank = both, rank + 1
        self.levels.append((rank, new))
        return found

    def clear(self) -> None:
        for _, name in self.levels:
            self.scratch.drop_table(name)
        self.levels = []


_SUFFIX = "k1 long, k2 long, doc_id long, pos long, back int, span int"


def _suffixes(docs: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """One row an anchor: block names, document, place, how far back its first string starts, how many more strings start after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_steps(batches):
            a, lo, hi, k1, k2 = anchors(buf, offs, cfg)
            doc = np.searchsorted(offs, a, side="right") - 1
            ids = rows.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids[doc]), pa.array(a - offs[doc]), pa.array((a - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32))], names=["k1", "k2", "doc_id", "pos", "back", "span"])

    return docs.mapInArrow(run, _SUFFIX)


def _lists(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct(*cols)).alias("at"))


def _at(rows: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """(row of each list entry, its fields), by row and first field."""
    lists = rows.column("at")
    many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(rows)), many)
    fields = lists.flatten()
    out = [fields.field(n).to_numpy(zero_copy_only=False) for n in names]
    order = np.lexsort((out[0], doc))
    return doc[order], *(z[order] for z in out)


def _reaches(texts: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """(h1, h2, k1, k2, doc_id, pos, back, span): the hash of all that an anchor's strings cover."""

    def run(batches):
        for rows, buf, offs in text_steps(batches):
            doc, pos, back, span = _at(rows, "pos", "back", "span")
            lo = offs[doc] + pos - back
            fit = (lo >= offs[doc]) & (lo + span + cfg.length <= offs[doc + 1])
            doc, pos, back, span, lo = (z[fit] for z in (doc, pos, back, span, lo))
            if not len(doc):
                continue
            order = np.argsort(lo, kind="stable")
            doc, pos, back, span, lo = (z[order] for z in (doc, pos, back, span, lo))
            h1, h2 = range_hashes(buf, lo, lo + span + cfg.length)
            form = mix(back.astype(np.uint64) << np.uint64(32) | span.astype(np.uint64))
            a = lo + back
            k1, k2 = (range_hashes(buf, a + k * cfg.block, a + (k + 1) * cfg.block, both=False)[0] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(z.view(np.int64)) for z in (h1 ^ form, h2 + form, k1, k2)), pa.array(rows.column("doc_id").to_numpy()[doc]), pa.array(pos), pa.array(back), pa.array(span)], names=["h1", "h2", "k1", "k2", "doc_id", "pos", "back", "span"])

    return texts.mapInArrow(run, "h1 long, h2 long, " + _SUFFIX)


def _strings(texts: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """(h1, h2, doc_id, s, single): the hash of each string of the listed anchors."""

    def run(batches):
        for rows, buf, offs in text_steps(batches, step=STEP_BYTES // 4):
            doc, pos, back, span, single = _at(rows, "pos", "back", "span", "single")
            lo = offs[doc] + pos - back
            fit = (lo >= offs[doc]) & (lo + span + cfg.length <= offs[doc + 1])
            doc, back, span, lo, single = (z[fit] for z in (doc, back, span, lo, single))
            for i in range(0, len(doc), 2000):
                part = [z[i : i + 2000] for z in (doc, back, span, lo, single)]
                many = part[2] + 1
                d, b, l, one = (np.repeat(part[k], many) for k in (0, 1, 3, 4))
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                s = l + step
                order = np.argsort(s, kind="stable")
                s, d, one, off = s[order], d[order], one[order], (b - step)[order]
                h1, h2 = range_hashes(buf, s, s + cfg.length)
                form = mix((off + (1 << 20)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array((h1 ^ form).view(np.int64)), pa.array((h2 + form).view(np.int64)), pa.array(rows.column("doc_id").to_numpy()[d]), pa.array(s - offs[d]), pa.array(one)], names=["h1", "h2", "doc_id", "s", "single"])

    return texts.mapInArrow(run, "h1 long, h2 long, doc_id long, s long, single boolean")


def _contexts(texts: DataFrame, cfg: SuffixConfig) -> DataFrame:
    """(k1, k2, doc_id, pos, back, span, single, left, right): the bytes of an anchor's reach before and after its blocks."""

    def run(batches):
        for rows, buf, offs in text_steps(batches):
            doc, pos, back, span, single = _at(rows, "pos", "back", "span", "single")
            lo = offs[doc] + pos - back
            fit = (lo >= offs[doc]) & (lo + span + cfg.length <= offs[doc + 1])
            doc, pos, back, span, single, lo = (z[fit] for z in (doc, pos, back, span, single, lo))
            if not len(doc):
                continue
            order = np.argsort(lo + back, kind="stable")
            doc, pos, back, span, single, lo = (z[order] for z in (doc, pos, back, span, single, lo))
            a, hi = lo + back, lo + span + cfg.length
            k1, k2 = (range_hashes(buf, a + k * cfg.block, a + (k + 1) * cfg.block, both=False)[0] for k in (0, 1))
            left, right = ([buf[x:y].tobytes() for x, y in zip(*z, strict=True)] for z in ((lo, a), (a + 2 * cfg.block, hi)))
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(rows.column("doc_id").to_numpy()[doc]), *(pa.array(z) for z in (pos, back, span, single)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["k1", "k2", "doc_id", "pos", "back", "span", "single", "left", "right"])

    return texts.mapInArrow(run, _SUFFIX + ", single boolean, left binary, right binary")


_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _padded(parts: list[bytes], wide: int, end: bool) -> np.ndarray:
    return np.frombuffer(b"".join((x.rjust if end else x.ljust)(wide, b"\0") for x in parts), dtype=np.uint8).reshape(len(parts), wide)


def _repeated_strings(table: pa.Table, cfg: SuffixConfig) -> pa.Table:
    """Runs (doc_id, lo, hi) of starts of single reaches' strings that another reach with the same names has as well.

    A string that starts o bytes before its anchor is the last o bytes of the left context, the blocks, and the first
    bytes of the right one; for each o the strings are told apart by a 64-bit hash within the task's few reaches.
    """
    back, span, pos, single = (table.column(c).to_numpy().astype(np.int64) for c in ("back", "span", "pos", "single"))
    key = mix(table.column("k1").to_numpy().view(np.uint64)) + table.column("k2").to_numpy().view(np.uint64)
    n, rest, wide = len(back), cfg.length - 2 * cfg.block, cfg.window
    left, right = _padded(table.column("left").to_pylist(), wide, end=True), _padded(table.column("right").to_pylist(), rest, end=False)
    after = np.empty((rest + 1, n), dtype=np.uint64)
    after[0] = key
    for i in range(rest):
        after[i + 1] = mix(after[i] * _FOLD + right[:, i])
    before = np.full(n, len(key), dtype=np.uint64)
    hit = np.zeros((n, wide + 1), dtype=bool)
    for o in range(wide):
        if o:
            before = mix(before * _FOLD + left[:, wide - o])
        here = np.flatnonzero((o >= back - span) & (o <= back))
        h = mix(before[here] ^ mix(after[rest - o, here]))
        order = np.argsort(h)
        same = np.zeros(len(here) + 1, dtype=bool)
        same[1:-1] = h[order][1:] == h[order][:-1]
        hit[here[order], o] = same[1:] | same[:-1]
    hit &= single.astype(bool)[:, None]
    flat = np.zeros((n, wide + 2), dtype=np.int8)
    flat[:, 1:] = hit
    turn = np.diff(flat, axis=1)
    row, first = np.nonzero(turn == 1)
    last = np.nonzero(turn == -1)[1] - 1
    return pa.table({"doc_id": table.column("doc_id").to_numpy()[row], "lo": pos[row] - last, "hi": pos[row] - first})


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the union of ranges, cut to 0..size."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(np.minimum(ends[order], size)) if len(ends) else ends
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(starts) else ends


def remove_repeats(docs: DataFrame, cfg: SuffixConfig | None = None, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but text and those named n_bytes, n_removed, n_spans or kept, with n_bytes, n_removed, n_spans, and kept binary: the bytes left; if ``as_text``, kept string, without the rest of characters cut in two.

    A byte goes if a string of cfg.length bytes that covers it starts anywhere else too, in the same document or
    another; strings don't cross documents and are judged on the input. Null texts are empty; texts shorter than
    cfg.length lose nothing. One row comes out for each row with a doc_id; repeated rows are copies of one another and
    so lose what is long enough. An empty table gives no rows.
    """
    cfg = cfg or SuffixConfig()
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "suffix")
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_bytes", "n_removed", "n_spans", "kept", "at")]
    docs = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    anchored = scratch.keep(_suffixes(docs.select("doc_id", "text"), cfg), "anchors")
    levels = SuffixLevels(spark, scratch)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(cfg.batches))
    found = [x for i in range(cfg.batches) for x in levels.add(anchored.where(batch == i).select("k1", "k2"))]
    levels.clear()
    matches = found[0]
    for x in found[1:]:
        matches = matches.unionByName(x)
    matches = scratch.keep(matches.distinct(), "names")
    scratch.drop(*found)
    n = partitions(spark)
    texts = spark.table(scratch.bucketed(docs.select(*rest, "text").repartition(n, "doc_id"), "texts", n, "doc_id"))  # the joins below move lists, not texts
    scratch.sweep()
    listed = scratch.keep(_lists(anchored.join(matches, ["k1", "k2"]), "pos", "back", "span"), "listed")
    scratch.drop(anchored, matches)
    few = lambda lists: texts.select("doc_id", "text").join(lists.hint("shuffle_hash"), "doc_id")
    reaches = scratch.keep(_reaches(few(listed), cfg), "reaches")
    scratch.drop(listed)
    scratch.sweep()
    # Copies of a reach become one row before anything meets by name, so a name that a third of all texts hold costs its different reaches.
    kinds = scratch.keep(reaches.groupBy("h1", "h2", "k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "back", "span")).alias("x")), "kinds")
    open_ = kinds.groupBy("k1", "k2").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1").select("k1", "k2", "kinds")
    whole = reaches.join(kinds.where("n > 1").select("h1", "h2", "k1", "k2"), ["h1", "h2", "k1", "k2"], "left_semi").select("doc_id", (F.col("pos") - F.col("back")).alias("lo"), (F.col("pos") - F.col("back") + F.col("span")).alias("hi"))
    one = kinds.join(open_, ["k1", "k2"]).select("x.*", (F.col("n") == 1).alias("single"), (F.col("kinds") > cfg.shard // 2).alias("crowded"))
    one = scratch.keep(one, "one")
    around = scratch.keep(_contexts(few(_lists(one.where("not crowded"), "pos", "back", "span", "single")), cfg), "contexts")
    shards = max(1, -(-around.count() // cfg.shard))
    shard = F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).cast("int")
    part = around.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda table: _repeated_strings(table, cfg), "doc_id long, lo long, hi long")
    strings = scratch.keep(_strings(few(_lists(one.where("crowded"), "pos", "back", "span", "single")), cfg), "strings")
    again = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    part = part.unionByName(strings.where("single").join(again, ["h1", "h2"], "left_semi").select("doc_id", F.col("s").alias("lo"), F.col("s").alias("hi")))
    spans = scratch.keep(_lists(whole.unionByName(part), "lo", "hi"), "spans")
    scratch.drop(reaches, kinds, one, around, strings)
    scratch.sweep()

    def cut(batches):
        for rows, buf, offs in text_steps(batches):
            doc, lo, hi = _at(rows, "lo", "hi")
            ptr = np.searchsorted(doc, np.arange(len(rows) + 1))
            out = []
            for i in range(len(rows)):
                text = buf[offs[i] : offs[i + 1]]
                a, b = covered(len(text), lo[ptr[i] : ptr[i + 1]], hi[ptr[i] : ptr[i + 1]] + cfg.length)
                edge = np.concatenate([[0], np.stack([a, b], axis=1).ravel(), [len(text)]]).astype(np.int64)
                kept = b"".join(text[x:y].tobytes() for x, y in zip(edge[::2], edge[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(a), kept))
            size, gone, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([k.decode(errors="ignore") for k in kept] if as_text else kept, pa.string() if as_text else pa.binary())], names=[*rest, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([*(f for f in texts.schema.fields if f.name in rest), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return texts.join(spans.hint("shuffle_hash"), "doc_id", "left").select(*rest, "text", "at").mapInArrow(cut, schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, tuple[int, int, int, str]]:
    """The definition, for small inputs: doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        flag = np.cumsum(gone)[:-1] > 0
        spans = int(flag[:1].sum() + (flag[1:] & ~flag[:-1]).sum())
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~flag])
        out[d] = (len(t), int(flag.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
