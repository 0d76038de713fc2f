"""Removal of word sequences that an earlier document holds, with suffix automata of reference shards.

Every window of ``width`` words has an anchor: the leftmost smallest of its grams. Windows can only be equal if their
anchors' grams are, so the anchors' grams say which parts of which documents can match. Those parts, cut down to the
distinct ones, are the reference; it is sharded by gram, each shard of bounded size. A suffix automaton of the shard
carries in each state the smallest document that holds the state's strings; the parts stream through it, and their
matching statistics say for each window which document holds it first.

Shards go to the parts that can match them instead of to all executors: to broadcast every shard to every document would
cost the square of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, mix, partitions, prepare, text_steps, word_hashes, word_spans
from .suffix import _at, _lists, _sliding_least, covered


@dataclass(frozen=True)
class AutomatonConfig:
    """width: words of a window. gram: words of an anchor. shard: parts in an automaton, about; a gram with more distinct parts than that is split into its single windows first, which need no automaton."""

    width: int = 13
    gram: int = 6
    shard: int = 8192


_FOLD = np.uint64(0x9E3779B97F4A7C15)
_FOLD2 = np.uint64(0xD1342543DE82EF95)


def _grams(words: np.ndarray, k: int, fold: np.uint64 = _FOLD) -> np.ndarray:
    out = np.full(max(len(words) - k + 1, 0), k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * fold + words[i : len(out) + i])
    return out


def anchors(words: np.ndarray, ptr: np.ndarray, cfg: AutomatonConfig) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first and last window that it serves), over texts' words laid end to end at ``ptr``."""
    none = np.zeros(0, np.int64)
    if len(words) < cfg.width:
        return none.astype(np.uint64), none, none, none
    grams = _grams(words, cfg.gram)
    index = np.uint64((1 << 22) - 1)
    if len(grams) > int(index):
        cuts = range(0, len(words), 1 << 21)
        parts = [anchors(words[i : i + (1 << 21) + cfg.width - 1], np.clip(ptr - i, 0, min((1 << 21) + cfg.width - 1, len(words) - i)), cfg) for i in cuts]
        return tuple(np.concatenate([p[k] + (np.uint64(0) if not k else i) for i, p in zip(cuts, parts, strict=True)]) for k in range(4))
    least = _sliding_least(grams & ~index | np.arange(len(grams), dtype=np.uint64), cfg.width - cfg.gram + 1)
    start = np.arange(len(words) - cfg.width + 1)
    whole = start + cfg.width <= ptr[np.minimum(np.searchsorted(ptr, start, side="right"), len(ptr) - 1)]
    pick, start = (least[: len(start)] & index).astype(np.int64)[whole], start[whole]
    if not len(pick):
        return none.astype(np.uint64), none, none, none
    new = np.ones(len(pick), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pick)) - 1
    return grams[pick[first]], pick[first], start[first], start[last]


class Automaton:
    """A generalised suffix automaton over word hashes; least[state]: the smallest owner of the state's strings."""

    def __init__(self, parts: list[tuple[list[int], int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for words, _ in parts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.least = [1 << 62] * len(self.size)
        for words, owner in parts:
            state = 0
            for w in words:
                state = self.next[state][w]
                if owner < self.least[state]:
                    self.least[state] = owner
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            if self.least[state] < self.least[up]:
                self.least[up] = self.least[state]

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            to = self.next[last][w]
            return to if self.size[to] == self.size[last] + 1 else self._clone(last, w, to)
        new = self._state(self.size[last] + 1, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][w]
            self.link[new] = to if self.size[to] == self.size[at] + 1 else self._clone(at, w, to)
        return new

    def _state(self, size: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1

    def _clone(self, at: int, w: int, to: int) -> int:
        new = self._state(self.size[at] + 1, dict(self.next[to]))
        self.link[new], self.link[to] = self.link[to], new
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = new
            at = self.link[at]
        return new

    def first_owners(self, words: list[int], width: int) -> list[int]:
        """For each window of ``width`` words, the smallest owner of a part that holds it; -1 where the match is shorter."""
        out, state, length = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            if i >= width - 1:
                if length < width:
                    out.append(-1)
                    continue
                at = state
                while self.size[self.link[at]] >= width:
                    at = self.link[at]
                out.append(self.least[at])
        return out


_PLACE = "doc_id long, pos long, back int, span int"


def _anchored(docs: DataFrame, cfg: AutomatonConfig) -> DataFrame:
    def run(batches):
        for rows, buf, offs in text_steps(batches):
            starts, ends, ptr = word_spans(buf, offs)
            key, a, lo, hi = anchors(word_hashes(buf, starts, ends, lower=False), ptr, cfg)
            doc = np.searchsorted(ptr, a, side="right") - 1
            ids = rows.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(a - ptr[doc]), pa.array((a - lo).astype(np.int32)), pa.array((hi - lo).astype(np.int32))], names=["key", "doc_id", "pos", "back", "span"])

    return docs.mapInArrow(run, "key long, " + _PLACE)


def _parts(texts: DataFrame, cfg: AutomatonConfig, full: bool) -> DataFrame:
    """The listed anchors' parts: all words of all their windows. key, two hashes of the part, place; if ``full``, its words too."""

    def run(batches):
        for rows, buf, offs in text_steps(batches):
            starts, ends, ptr = word_spans(buf, offs)
            words = word_hashes(buf, starts, ends, lower=False)
            doc, pos, back, span = _at(rows, "pos", "back", "span")
            lo = ptr[doc] + pos - back
            fit = (lo >= ptr[doc]) & (lo + span + cfg.width <= ptr[doc + 1])
            doc, pos, back, span, lo = (z[fit] for z in (doc, pos, back, span, lo))
            if not len(doc):
                continue
            gram = _grams(words, cfg.gram)
            hashes = []
            for fold in (_FOLD, _FOLD2):
                h = mix((back.astype(np.uint64) << np.uint64(32)) + span.astype(np.uint64))
                for i in range(int(span.max()) + cfg.width):
                    go = i < span + cfg.width
                    h[go] = mix(h[go] * fold + words[lo[go] + i])
                hashes.append(h)
            out = [gram[lo + back], *hashes]
            extra = []
            if full:
                many = span + cfg.width
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                extra = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), pa.array(words[at].view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*(pa.array(z.view(np.int64)) for z in out), pa.array(rows.column("doc_id").to_numpy()[doc]), *(pa.array(z) for z in (pos, back, span)), *extra], names=["key", "h1", "h2", "doc_id", "pos", "back", "span", *["words"] * full])

    return texts.mapInArrow(run, "key long, h1 long, h2 long, " + _PLACE + ", words array<long>" * full)


def remove_earlier(docs: DataFrame, cfg: AutomatonConfig | None = None) -> DataFrame:
    """All columns of ``docs`` but text and those named n_words, n_removed or kept, with n_words, n_removed, and kept string: the words left, joined by one space.

    A word goes if a window of cfg.width words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged. Null and wordless texts have no words.
    One row comes out for each row with a doc_id; rows that share a doc_id are one document and remove nothing of one
    another. An empty table gives no rows.
    """
    cfg = cfg or AutomatonConfig()
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "automaton")
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_words", "n_removed", "kept", "at")]
    docs = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    anchored = scratch.keep(_anchored(docs.select("doc_id", "text"), cfg), "anchors")
    shared = scratch.keep(anchored.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key"), "shared")
    scratch.sweep()
    listed = scratch.keep(_lists(anchored.join(shared, "key", "left_semi"), "pos", "back", "span"), "listed")
    scratch.drop(anchored, shared)
    scratch.sweep()
    n = partitions(spark)
    texts = spark.table(scratch.bucketed(docs.select(*rest, "text").repartition(n, "doc_id"), "texts", n, "doc_id"))  # the joins below move lists, not texts
    scratch.sweep()
    few = lambda lists: texts.select("doc_id", "text").join(lists.hint("shuffle_hash"), "doc_id")
    parts = scratch.keep(_parts(few(listed), cfg, full=False), "parts")
    kind = ["key", "h1", "h2"]
    # Copies of a part become one row before anything meets by gram, so a gram that a third of all texts hold costs its different parts.
    kinds = scratch.keep(parts.groupBy(*kind).agg(F.min(F.struct("doc_id", "pos", "back", "span")).alias("x")), "kinds")
    marked = scratch.keep(kinds.join(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "key"), "marked")
    scratch.drop(kinds)
    one = marked.where("kinds > 1").select("x.*")
    reference = _parts(few(_lists(one, "pos", "back", "span")), cfg, full=True).select(*kind, F.col("doc_id").alias("first"), "words")
    reference = scratch.keep(reference.join(marked.select(*kind, "kinds"), kind), "reference")
    # A part of a crowded gram falls into its single windows, whose first documents need no automaton.
    crowded = reference.where(F.col("kinds") > cfg.shard).select(*kind, "first", F.posexplode(F.expr(f"transform(sequence(1, size(words) - {cfg.width - 1}), i -> slice(words, i, {cfg.width}))")).alias("i", "window"))
    crowded = crowded.withColumns({"w1": F.xxhash64("window"), "w2": F.xxhash64(F.lit(1), "window")}).drop("window")
    firsts = crowded.groupBy("w1", "w2").agg(F.min("first").alias("owner"))
    crowded = crowded.join(firsts, ["w1", "w2"]).select(*kind, "i", "owner")
    shards = max(1, -(-reference.where(F.col("kinds") <= cfg.shard).count() // cfg.shard))
    width = cfg.width

    def stream(table: pa.Table) -> pa.Table:
        words = table.column("words").to_pylist()
        automaton = Automaton(list(zip(words, table.column("first").to_pylist(), strict=True)))
        owners = [automaton.first_owners(w, width) for w in words]
        many = [len(x) for x in owners]
        out = table.select(kind).take(pa.array(np.repeat(np.arange(len(words)), many)))
        return out.append_column("i", pa.array(np.concatenate([np.arange(m) for m in many]), pa.int32())).append_column("owner", pa.array([o for x in owners for o in x], pa.int64()))

    sharded = reference.where(F.col("kinds") <= cfg.shard).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    told = sharded.groupBy("shard").applyInArrow(stream, "key long, h1 long, h2 long, i int, owner long").unionByName(crowded)
    told = told.where("owner >= 0").groupBy(*kind).agg(F.collect_list(F.struct("i", "owner")).alias("told"))  # a part has few windows
    first = marked.where("kinds = 1").select(*kind, F.col("x.doc_id").alias("first"), F.lit(None).cast("array<struct<i:int,owner:long>>").alias("told"))
    verdicts = scratch.keep(first.unionByName(told.withColumn("first", F.lit(None).cast("long"))), "verdicts")
    # A part alone with its gram goes whole where it isn't the first of its kind; of the others each window is judged.
    lo = F.col("pos") - F.col("back")
    whole = F.when(F.col("first") < F.col("doc_id"), F.array(F.struct(lo.alias("lo"), (lo + F.col("span")).alias("hi"))))
    single = F.transform(F.filter("told", lambda w: w["owner"] < F.col("doc_id")), lambda w: F.struct((lo + w["i"]).alias("lo"), (lo + w["i"]).alias("hi")))
    found = parts.join(verdicts, kind).select("doc_id", F.coalesce(whole, single).alias("at")).where(F.size("at") > 0)
    spans = scratch.keep(found.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at")), "spans")
    scratch.drop(parts, marked, reference, verdicts, listed)
    scratch.sweep()

    def cut(batches):
        for rows, buf, offs in text_steps(batches):
            starts, ends, ptr = word_spans(buf, offs)
            doc, lo, hi = _at(rows, "lo", "hi")
            at = np.searchsorted(doc, np.arange(len(rows) + 1))
            out = []
            for i in range(len(rows)):
                n = int(ptr[i + 1] - ptr[i])
                a, b = covered(n, lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]] + width)
                words = buf[offs[i] : offs[i + 1]].tobytes().split()
                edge = [0, *(int(x) for x in np.stack([a, b], axis=1).ravel()), n]
                kept = [w for x, y in zip(edge[::2], edge[1::2], strict=True) for w in words[x:y]]
                out.append((n, n - len(kept), b" ".join(kept).decode()))
            size, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*rest, "n_words", "n_removed", "kept"])

    schema = T.StructType([*(f for f in texts.schema.fields if f.name in rest), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return texts.join(spans.hint("shuffle_hash"), "doc_id", "left").select(*rest, "text", "at").mapInArrow(cut, schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str], width: int) -> dict[int, tuple[int, int, str]]:
    """The definition, for small inputs: doc_id -> (n_words, n_removed, kept_sha256)."""
    import hashlib

    first: dict[tuple, int] = {}
    words = {d: t.encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for s in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][s : s + width]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < d:
                gone.update(range(s, s + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
