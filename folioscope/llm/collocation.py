"""Phrase collocations by pivot partitioning.

Every phrase belongs to its pivot, its rarest word (the first, where several are as rare). A text is not sent whole: for
each place of a word w that can be in a candidate, the fragment around it goes to w's part, cut at the phrase length, at
the ends of the piece and at the first word rarer than w, so that what arrives holds only phrases that w owns. A part mines its
fragments by itself, growing phrases from the pivot outwards and dropping those that are too rare at each step, and
reports only what it owns: nothing is counted twice, and no part needs another's counts.

How rare a word is comes from a table of counters of fixed size, indexed by the word's hash, which is broadcast. A counter is the
sum over the words that share it, so it never understates: a word under the least count there can't be in a candidate.
Ownership only needs the same order everywhere, so shared counters cost pruning and never change a result; counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_by, mix, partitions, text_steps, word_hashes, word_spans


@dataclass(frozen=True)
class CollocationConfig:
    """least: occurrences of a candidate. longest: its words at most. share: a candidate goes if a longer one that holds it has so many hundredths of its occurrences. top: phrases of a language. cells: counters, a power of two. tokens: words whose fragments one task mines, about, in ``turns`` turns; a pivot with more than one turn takes is dealt to several parts. step: bytes of text at a time."""

    least: int = 100
    longest: int = 5
    share: int = 100
    top: int = 2000
    cells: int = 1 << 20
    tokens: int = 12_000_000
    turns: int = 4
    step: int = 4 << 20


#: Lower case for A-Z, and a line feed for what ends a piece.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A


def _dense(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the values that occur, in order; which of them each x is; how often each occurs) of x, whole numbers below size."""
    if size > max(1 << 16, 16 * len(x)):
        return np.unique(x, return_inverse=True, return_counts=True)
    many = np.bincount(x, minlength=size)
    kept = np.flatnonzero(many)
    table = np.zeros(size, dtype=np.int64)
    table[kept] = np.arange(len(kept))
    return kept, table[x], many[kept]


@dataclass(frozen=True)
class Words:
    """The words of a step: which entry each is, its text and its piece; the entries (language and word), their hashes and counts."""

    entry: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    langs: pa.Array
    words: pa.Array
    hashes: np.ndarray
    many: np.ndarray


def _words(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Words | None:
    low = _FOLD[buf]
    starts, ends, ptr = word_spans(low, offs)
    if not len(starts):
        return None
    text = np.repeat(np.arange(len(rows)), np.diff(np.append(ptr[:-1], len(starts))))
    size = ends - starts
    data = low[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    at = np.concatenate([[0], np.cumsum(size)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    kinds = words.dictionary
    bounds = np.frombuffer(kinds.buffers()[1], dtype=np.int64)[: len(kinds) + 1]
    hashes = word_hashes(np.frombuffer(kinds.buffers()[2], dtype=np.uint8), bounds[:-1], bounds[1:], False)
    lang = rows.column("lang").dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()], dtype=np.uint64)
    pairs = lang.indices.to_numpy().astype(np.int64)[text] * len(kinds) + words.indices.to_numpy()
    kept, entry, many = _dense(pairs, len(seeds) * len(kinds))
    of, word = np.divmod(kept, len(kinds))
    ended = np.cumsum(low == 0x0A)[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (ended[1:] != ended[:-1]) | (text[1:] != text[:-1])
    return Words(entry, text, np.cumsum(new), lang.dictionary.take(pa.array(of)), kinds.take(pa.array(word)).cast(pa.large_string()).cast(pa.string()), mix(hashes[word] ^ seeds[of]), many)


def _steps(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``text_steps`` over batches put together until they have ``step`` bytes of text: a step's words are told apart once."""

    def gathered():
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= step:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return text_steps(gathered(), step=step)


def word_counts(docs: DataFrame, cells: int, step: int) -> DataFrame:
    """lang, word, cell (its counter), n: the occurrences of every word."""

    def count(batches):
        for rows, buf, offs in _steps(batches, step):
            w = _words(rows, buf, offs)
            if w is not None:
                yield pa.RecordBatch.from_arrays([w.langs, w.words, pa.array((w.hashes & np.uint64(cells - 1)).astype(np.int32)), pa.array(w.many)], names=["lang", "word", "cell", "n"])

    return docs.mapInArrow(count, "lang string, word string, cell int, n long").groupBy("lang", "word", "cell").agg(F.sum("n").alias("n"))


# -- fragments ----------------------------------------------------------------------------------------------------------


def _reach(order: np.ndarray, piece: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left of each place are in its piece and less rare, and how many to the right are not rarer, without a break and at most ``most``."""
    left, right = np.zeros(len(order), dtype=np.uint8), np.zeros(len(order), dtype=np.uint8)
    before, after = (np.ones(len(order), dtype=bool) for _ in range(2))
    for d in range(1, most + 1):
        same = piece[d:] == piece[:-d]
        before[:d] = False
        before[d:] &= same & (order[:-d] > order[d:])
        after[max(len(order) - d, 0) :] = False
        after[:-d] &= same & (order[d:] >= order[:-d])
        left += before
        right += after
    return left, right


_FRAGMENTS = "part int, whole boolean, wide boolean, kinds int, chars int, langs array<string>, entries binary, n array<int>, ids array<int>, bodies array<binary>"


def _planes(x: np.ndarray, wide: bool) -> bytes:
    """The lowest bytes of all numbers, then the next ones: like bytes together compress better."""
    return x.astype("<u4" if wide else "<u2").view(np.uint8).reshape(len(x), 4 if wide else 2).T.tobytes()


def _unplaned(raw: bytes, offset: int, n: int, wide: bool) -> np.ndarray:
    width = 4 if wide else 2
    return np.frombuffer(raw, dtype=np.uint8, offset=offset, count=n * width).reshape(width, n).T.copy().view("<u4" if wide else "<u2").reshape(n)


def _fragments(w: Words, doc_ids: np.ndarray, counters: np.ndarray, parts: int, cfg: CollocationConfig) -> Iterator[tuple]:
    """A row for each part: its fragments' entries, the commonest first, and for each turn a body of the fragments: places left and right of the pivot, then which entries their words are."""
    count = counters[(w.hashes & np.uint64(cfg.cells - 1)).astype(np.int64)]
    rank = np.where(count >= cfg.least, (count << 20) | (w.hashes >> np.uint64(44)).astype(np.int64), -1)
    order = rank[w.entry]
    left, right = _reach(order, w.piece, cfg.longest - 1)
    at = np.flatnonzero((order >= 0) & (left + right > 0))
    if not len(at):
        return
    pivot, left, right = w.entry[at], left[at], right[at]
    many = -(-count * cfg.turns // cfg.tokens)[pivot]  # parts that share the pivot
    whole = many <= 1
    home = w.hashes[pivot]
    spread = mix(doc_ids[w.text[at]].astype(np.uint64) + np.uint64(1)) % np.maximum(many, 1).astype(np.uint64)
    part = ((home >> np.uint64(8)) + np.where(whole, np.uint64(0), spread)) % np.uint64(parts)
    turn = (mix(home) % np.uint64(cfg.turns)).astype(np.int64)
    _, which, held = _dense((part.astype(np.int64) * 2 + whole) * cfg.turns + turn, parts * 2 * cfg.turns)
    sort = np.argsort(which, kind="stable")
    at, left, right, part, whole, turn = at[sort], left[sort].astype(np.int64), right[sort].astype(np.int64), part[sort], whole[sort], turn[sort]
    size = left + right + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])])
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        some = size[lo:hi]
        ids = w.entry[np.repeat(at[lo:hi] - left[lo:hi] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))]
        kept, ids, often = _dense(ids, len(rank))
        common = np.argsort(-often, kind="stable")
        place = np.empty(len(kept), dtype=np.int64)
        place[common] = np.arange(len(kept))
        ids, kept, wide = place[ids], pa.array(kept[common]), len(kept) > 1 << 16
        langs = w.langs.take(kept).dictionary_encode()
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), w.words.take(kept)), " ")[0].as_py().encode()
        entries = _planes(langs.indices.to_numpy(), True) + words
        bodies, n, each = [], [], []
        for t in range(cfg.turns):
            a, b = lo + np.searchsorted(turn[lo:hi], [t, t + 1])
            mine = ids[ends[a] - ends[lo] : ends[b] - ends[lo]]
            n.append(int(b - a))
            each.append(len(mine))
            bodies.append(pa.compress((left[a:b] * 16 + right[a:b]).astype(np.uint8).tobytes() + _planes(mine, wide), "zstd", asbytes=True))
        yield int(part[lo]), bool(whole[lo]), wide, len(kept), len(entries), langs.dictionary.to_pylist(), pa.compress(entries, "zstd", asbytes=True), n, each, bodies


def _entries(row: tuple) -> tuple[pa.Array, pa.Array]:
    """(languages, words) of a row of ``_fragments``."""
    _, kinds, chars, langs, entries, *_ = row
    raw = pa.decompress(entries, chars, "zstd", asbytes=True)
    text = np.frombuffer(raw, dtype=np.uint8, offset=4 * kinds)
    space = np.flatnonzero(text == 0x20)
    ends = np.concatenate([[0], space - np.arange(len(space)), [len(text) - len(space)]]).astype(np.int32)
    words = pa.StringArray.from_buffers(kinds, pa.py_buffer(ends), pa.py_buffer(text[text != 0x20]))
    return pa.array(langs).take(pa.array(_unplaned(raw, 0, kinds, True))), words


# -- mining -------------------------------------------------------------------------------------------------------------


def _mined(words: np.ndarray, left: np.ndarray, right: np.ndarray, kinds: int, longest: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words before the pivot, the words of each phrase as rows, occurrences): all phrases with the pivot that occur ``least`` times or more."""
    pivot = np.cumsum(left + right + 1) - right - 1

    def grown(rows: np.ndarray, key: np.ndarray, shift: int, reach: np.ndarray) -> tuple:
        """The phrases longer by the word ``shift`` places from the pivot: (rows, key, a row of each phrase, occurrences)."""
        on = reach[rows] >= abs(shift)
        rows = rows[on]
        _, first, key, many = np.unique(key[on] * kinds + words[pivot[rows] + shift], return_index=True, return_inverse=True, return_counts=True)
        often = many >= least
        new = np.cumsum(often) - 1
        go = often[key]
        return rows[go], new[key[go]], rows[first[often]], many[often]

    rows, key = np.arange(len(left)), words[pivot]
    for i in range(longest):
        if i:
            rows, key, some, many = grown(rows, key, -i, left)
            if not len(rows):
                return
            yield i, words[pivot[some][:, None] + np.arange(-i, 1)], many
        on, under = rows, key
        for j in range(1, longest - i):
            on, under, some, many = grown(on, under, j, right)
            if not len(on):
                break
            yield i, words[pivot[some][:, None] + np.arange(-i, j + 1)], many


def _phrases(rows: list[tuple], cfg: CollocationConfig, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, a) of what ``_fragments``' rows hold; the bodies of one turn are unpacked at a time."""
    langs, words = (pa.concat_arrays(x) for x in zip(*map(_entries, rows), strict=True))
    langs, words = langs.dictionary_encode(), words.dictionary_encode()
    every, code, _ = _dense(langs.indices.to_numpy().astype(np.int64) * len(words.dictionary) + words.indices.to_numpy(), len(langs.dictionary) * len(words.dictionary))
    of, word = np.divmod(every, len(words.dictionary))
    langs, names = langs.dictionary.take(pa.array(of)), words.dictionary.take(pa.array(word))
    starts = np.concatenate([[0], np.cumsum([r[1] for r in rows])])
    for t in range(cfg.turns):
        ids, sides = [], []
        for (wide, _, _, _, _, n, each, bodies), start in zip(rows, starts[:-1], strict=True):
            raw = pa.decompress(bodies[t], n[t] + each[t] * (4 if wide else 2), "zstd", asbytes=True)
            sides.append(np.frombuffer(raw, dtype=np.uint8, count=n[t]))
            ids.append(code[_unplaned(raw, n[t], each[t], wide) + start].astype(np.int32))
        side = np.concatenate(sides).astype(np.int64)
        for _, phrases, many in _mined(np.concatenate(ids), side // 16, side % 16, len(every), cfg.longest, least):
            columns = [names.take(pa.array(phrases[:, c])) for c in range(phrases.shape[1])]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(phrases[:, 0])), pc.binary_join_element_wise(*columns, " "), pa.array(many)], names=["lang", "phrase", "a"])


def frequent_phrases(docs: DataFrame, counters: np.ndarray, tokens: int, cfg: CollocationConfig) -> DataFrame:
    """lang, phrase, a: phrases of two words or more with their occurrences, cfg.least or more; exact."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counters)  # cfg.cells numbers
    parts = max(-(-tokens // cfg.tokens), min(partitions(spark), spark.sparkContext.defaultParallelism))
    step, most = cfg.step, 12 * cfg.tokens

    names = [c.split()[0] for c in _FRAGMENTS.split(", ")]
    ints = pa.list_(pa.int32())
    types = [pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary(), ints, ints, pa.list_(pa.binary())]

    def cut(batches):
        for rows, buf, offs in _steps(batches, step):
            w = _words(rows, buf, offs)
            out = [] if w is None else list(_fragments(w, rows.column("dealt").to_numpy(), shared.value, parts, cfg))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def mine(batches):
        held: dict[bool, list] = {True: [], False: []}
        size, over = 0, False
        for batch in batches:
            columns = [batch.column(c) for c in names[2:]]
            for i, whole in enumerate(batch.column("whole").to_pylist()):
                held[whole].append(tuple(c[i].as_py() for c in columns))
                size += sum(held[whole][-1][6])
                if size > most:  # what has come so far is reported unpruned, and so is the rest
                    over = True
                    for rows in filter(None, held.values()):
                        yield from _phrases(rows, cfg, 1)
                    held, size = {True: [], False: []}, 0
        for whole, rows in held.items():
            if rows:
                yield from _phrases(rows, cfg, cfg.least if whole and not over else 1)

    fragments = docs.mapInArrow(cut, _FRAGMENTS).repartitionById(parts, "part")
    return fragments.mapInArrow(mine, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= cfg.least)


# -- scores -------------------------------------------------------------------------------------------------------------


def _joined(words, start, n):
    return F.array_join(F.slice(words, start, n), " ")


def _keyed(lang, phrase):
    return F.concat_ws("\n", lang, phrase)  # a phrase has no line feed


def scored(candidates: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a) with l, r, n and score, of the cut with the lowest score; ``known`` has f of every word and candidate, ``totals`` n of each lang."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), _joined("w", F.lit(1), F.col("k")).alias("p")), F.struct(F.lit(1).alias("side"), _joined("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("p"))))
    cuts = cuts.withColumn("e", ends).select("lang", "phrase", "a", "k", "e.side", _keyed("lang", "e.p").alias("key"))
    asked = cuts.groupBy("key").agg(F.count("*").alias("asked"))
    total = asked.agg(F.sum("asked")).first()[0] or 0
    parts = join_by(cuts, known.select(_keyed("lang", "phrase").alias("key"), "f").join(asked, "key"), "key", "asked", total)
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("f")))
    parts = parts.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    held = candidates.groupBy("lang").agg(F.count("*").alias("held")).join(totals, "lang")
    parts = join_by(parts, held, "lang", "held", held.agg(F.sum("held")).first()[0] or 0)
    score = F.expr("(cast(a as decimal(19, 0)) * 1000 * cast(n as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = parts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def covered(candidates: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, longer): of phrases inside longer candidates, the most occurrences of such a one."""
    words = candidates.select("lang", F.col("a").alias("longer"), F.split("phrase", " ").alias("w")).where(F.size("w") > 2)
    words = words.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return words.select("lang", _joined("w", F.col("i"), F.col("n")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, cfg: CollocationConfig | None = None) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's cfg.top phrases by score, then a, then phrase in byte order.

    ``docs`` has doc_id, text and lang; other columns are ignored. A-Z are lower-cased; ``[.,;:!?]`` and line breaks end a piece,
    and its words are ``[^\\x20\\x09]+``. n counts a language's words; candidates are phrases of 2 to cfg.longest words within a piece that occur cfg.least times or more,
    overlaps counted. Null texts are empty, a null language is ``und``. doc_id only deals rows out and may be null; repeated rows count each.
    A candidate goes if a longer candidate around it has cfg.share hundredths of its occurrences. No texts give no rows.
    """
    cfg = cfg or CollocationConfig()
    scratch = Scratch(docs.sparkSession, "collocation")
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("dealt"))
    counts = scratch.keep(word_counts(docs, cfg.cells, cfg.step), "words")
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.least).toArrow()  # cfg.cells rows at most
    counters = np.zeros(cfg.cells, dtype=np.int64)
    counters[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    totals = scratch.keep(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    candidates = scratch.keep(frequent_phrases(docs, counters, tokens, cfg), "candidates")
    known = candidates.select("lang", "phrase", F.col("a").alias("f")).unionByName(counts.where(F.col("n") >= cfg.least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    inside = covered(candidates, cfg.share).where("longer is not null")
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cfg.share * F.col("a"), F.lit(True))).drop("longer")
    out = scored(kept, known, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= cfg.top)  # so that the last window sorts 64 times cfg.top rows of a language at most
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= cfg.top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
