"""Unigram tokenization with SentencePiece vocabularies: encoding, decoding, and counting alone.

Encoding runs Viterbi over a double-array trie of the pieces. Counting enumerates the pieces' matches with an
Aho-Corasick automaton over the same trie and carries the best score and its number of pieces. Both keep the library's
tie rules: of paths with the same score to a place, the one whose last piece starts first stays; a character that is no
piece by itself costs the smallest score less 10 and falls back to its bytes.

A vocabulary of another kind, whose pieces are ranked instead of scored, is read as a unigram model by Zipf's law: see
``as_unigram``.

Spaces are written as the marker U+2581 and one stands before every text that isn't empty. No piece has a marker after
another character, so a text falls into chunks (markers and what follows them) that are solved once a batch each;
scores add up in double precision, exactly for whole-numbered scores, where the library rounds to single precision.
"""

from __future__ import annotations

import codecs
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, prepare, text_steps
from .suffix import range_hashes

MARK = "▁"
codecs.register_error("each", lambda e: ("\ufffd" * (e.end - e.start), e.end))
#: Chunks of more bytes are solved one by one.
LONG = 64
_STEP = 2 << 20


#: Scores are multiples of 1 / STEPS, so that sums of them are exact in the library's single precision up to 1,000,000.
STEPS = 16


def as_unigram(path: str) -> bytes:
    """The vocabulary file as a unigram model that the library can load.

    A unigram file stays as it is. Others order their pieces by rank, the score less its sign: nothing is trained, the
    rank r stands for the log probability -ln((r + 1) H), with H the sum of all 1 / (r + 1), rounded to 1 / STEPS. Ranks behind the last piece count as the last.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != model.trainer_spec.UNIGRAM:
        model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
        plain = [p for p in model.pieces if p.type == p.NORMAL]
        ranks = np.minimum([-p.score for p in plain], len(model.pieces))
        scores = -np.log((ranks + 1) * (1 / (ranks + 1)).sum())
        for p, score in zip(plain, np.round(scores * STEPS) / STEPS, strict=True):
            p.score = score
    return model.SerializeToString()


@dataclass
class Vocabulary:
    """Pieces that match text (ids, scores, bytes), the ids of the 256 byte pieces (-1 without fallback), the unknown id and its score."""

    pieces: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    surface: list[bytes]  #: of each id, for decoding
    is_byte: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=as_unigram(path))
        rows = [(i, sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i), sp.is_control(i) or sp.is_unknown(i), sp.is_unused(i)) for i in range(sp.get_piece_size())]
        return Vocabulary.build(rows, sp.unk_id())

    @staticmethod
    def build(rows: list[tuple], unknown: int) -> Vocabulary:
        """rows: (id, piece, score, is_byte, is_special, is_unused)."""
        plain = [r for r in rows if not (r[3] or r[4] or r[5])]
        if any(MARK in p.lstrip(MARK) for _, p, *_ in plain):
            raise ValueError("a piece has a marker after another character")
        byte_ids = np.full(256, -1, dtype=np.int32)
        for i, p, *_ in (r for r in rows if r[3]):
            byte_ids[int(p[3:5], 16)] = i
        surface = [b""] * (max((r[0] for r in rows), default=-1) + 1)
        is_byte = np.zeros(len(surface), dtype=bool)
        for i, p, _, byte, special, _ in rows:
            surface[i] = bytes([int(p[3:5], 16)]) if byte else " ⁇ ".encode() if i == unknown else b"" if special else p.encode()
            is_byte[i] = byte
        return Vocabulary([p.encode() for _, p, *_ in plain], np.array([r[0] for r in plain], dtype=np.int32), np.array([r[2] for r in plain], dtype=np.float64), byte_ids, unknown, min((r[2] for r in plain), default=0.0) - 10, surface, is_byte)


def _placed(nodes: list[dict[int, int]]) -> tuple[list[int], list[int]]:
    """Base and slot of each node: crowded nodes take the first base whose children's slots are all free."""
    free = np.ones(4 * len(nodes) + 4096, dtype=bool)
    free[0] = False
    base, slot = [0] * len(nodes), [0] * len(nodes)
    first = 1
    for node in sorted((n for n in range(len(nodes)) if nodes[n]), key=lambda n: -len(nodes[n])):
        kids = np.array(sorted(nodes[node]))
        while not free[first]:
            first += 1
        low, wide = first, 64
        while True:
            at = np.flatnonzero(free[low : low + wide]) + low - kids[0]
            at = at[at >= 1]
            fit = free[at[:, None] + kids].all(axis=1)
            if fit.any():
                break
            low, wide = low + wide, 2 * wide
        base[node] = int(at[fit.argmax()])
        free[base[node] + kids] = False
        for c, kid in nodes[node].items():
            slot[kid] = base[node] + c
    return base, slot


@dataclass
class DoubleArray:
    """Child of state s by byte c: t = base[s] + c if check[t] == s. value[t]: the piece that ends in t, or -1. fail, out: Aho-Corasick's links to the longest proper suffix that is a state, and to the longest that is a piece (0: none)."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    fail: np.ndarray
    out: np.ndarray

    @staticmethod
    def build(pieces: list[bytes]) -> DoubleArray:
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][c]
            ends[at] = i
        base, slot = _placed(nodes)
        n = max(slot) + max(base) + 512
        out = DoubleArray(*(np.full(n, x, dtype=np.int32) for x in (0, -1, -1, 0, 0)))
        for node, kids in enumerate(nodes):
            out.base[slot[node]], out.value[slot[node]] = base[node], ends[node]
            out.check[[slot[k] for k in kids.values()]] = slot[node]
        b, check, value, fail, link = (x.tolist() for x in (out.base, out.check, out.value, out.fail, out.out))
        order = [0]
        for node in order:  # breadth first
            s = slot[node]
            for c, kid in nodes[node].items():
                f = fail[s] if node else -1
                while f > 0 and check[b[f] + c] != f:
                    f = fail[f]
                t, up = slot[kid], 0 if f < 0 else b[f] + c
                fail[t] = f = up if f >= 0 and check[up] == f else 0
                link[t] = f if value[f] >= 0 else link[f]
                order.append(kid)
        out.fail[:], out.out[:] = fail, link
        return out

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.base[state] + c
        return to, self.check[to] == state


_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:] = 2, 3, 4


class Solver:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.trie = vocabulary, DoubleArray.build(vocabulary.pieces)
        self.sizes = np.array([len(p) for p in vocabulary.pieces] or [0], dtype=np.int64)
        self.fallback = bool((vocabulary.byte_ids >= 0).all())

    def _unknown_pieces(self, chars: np.ndarray) -> np.ndarray:
        return chars if self.fallback else np.ones_like(chars)

    # -- encoding ---------------------------------------------------------------------------------------------------

    def encode(self, chunks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row of ``chunks`` (bytes, padded; ``size`` bytes each), end to end, and where each row's begin."""
        n, wide = chunks.shape
        best = np.full((n, wide + 1), -np.inf)
        best[:, 0] = 0
        start, piece = (np.zeros((n, wide + 1), dtype=np.int32) for _ in range(2))
        for p in range(wide):
            rows = np.flatnonzero((best[:, p] > -np.inf) & (p < size))
            if not len(rows):
                continue
            here, chars = best[rows, p], _CHAR[chunks[rows, p]]
            single = np.zeros(len(rows), dtype=bool)
            at, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int32)
            for j in range(p, wide):
                state, ok = self.trie.step(state, chunks[rows[at], j])
                ok &= j < size[rows[at]]
                at, state = at[ok], state[ok]
                if not len(at):
                    break
                which = self.trie.value[state]
                hit = np.flatnonzero(which >= 0)
                if len(hit):
                    k, w = at[hit], which[hit]
                    single[k[chars[k] == j + 1 - p]] = True
                    self._better(best, start, piece, rows[k], p, j + 1, here[k] + self.v.scores[w], w)
            lost = np.flatnonzero(~single)
            for many in np.unique(chars[lost]):
                k = lost[chars[lost] == many]
                self._better(best, start, piece, rows[k], p, min(p + int(many), wide), here[k] + self.v.unknown_score, np.full(len(k), -1))
        back, pos = [], size.astype(np.int64).copy()
        rows = np.arange(n)
        while len(rows := rows[pos[rows] > 0]):
            at = pos[rows]
            back.append((rows, start[rows, at], at, piece[rows, at]))
            pos[rows] = start[rows, at]
        if not back:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        row, lo, hi, which = (np.concatenate(z[::-1]) for z in zip(*back, strict=True))
        order = np.lexsort((lo, row))
        row, lo, hi, which = row[order], lo[order], hi[order], which[order]
        many = np.where(which >= 0, 1, self._unknown_pieces(hi - lo))
        ids = np.repeat(np.where(which >= 0, self.v.ids[np.maximum(which, 0)] if len(self.v.ids) else 0, self.v.unknown), many).astype(np.int32)
        if self.fallback:
            odd = np.repeat(which < 0, many)
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
            ids[odd] = self.v.byte_ids[chunks[np.repeat(row, many)[odd], (np.repeat(lo, many) + inside)[odd]]]
        ends = np.zeros(n + 1, dtype=np.int64)
        np.add.at(ends, row + 1, many)
        return ids, np.cumsum(ends)

    @staticmethod
    def _better(best, start, piece, rows, p, end, score, which) -> None:
        up = score > best[rows, end]
        rows = rows[up]
        best[rows, end], start[rows, end], piece[rows, end] = score[up], p, which[up]

    # -- counting ---------------------------------------------------------------------------------------------------

    def count(self, chunks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, score) of each row's best path; no path is kept."""
        n, wide = chunks.shape
        best, many = np.full((n, wide + 1), -np.inf), np.zeros((n, wide + 1), dtype=np.int64)
        best[:, 0] = 0
        trie, state = self.trie, np.zeros(n, dtype=np.int32)
        begun = np.zeros(n, dtype=np.int64)  # where the character that the place belongs to starts
        for e in range(wide):
            rows = np.flatnonzero(e < size)
            if not len(rows):
                break
            c = chunks[rows, e]
            lead = (c & 0xC0) != 0x80
            begun[rows[lead]] = e
            now, todo = state[rows], np.arange(len(rows))
            while len(todo):
                to, ok = trie.step(now[todo], c[todo])
                now[todo[ok]] = to[ok]
                todo = todo[~ok]
                ended = now[todo] == 0
                todo = todo[~ended]
                now[todo] = trie.fail[now[todo]]
            state[rows] = now
            char = e + 1 - begun[rows]
            whole = char == _CHAR[chunks[rows, begun[rows]]]
            single = np.zeros(len(rows), dtype=bool)
            match = np.where(trie.value[now] >= 0, now, trie.out[now])
            at = np.flatnonzero(match)
            while len(at):  # longest first, so the earliest start stays in a tie
                w = trie.value[match[at]]
                s = self.sizes[w]
                single[at[s == char[at]]] = True
                r = rows[at]
                score = best[r, e + 1 - s] + self.v.scores[w]
                up = score > best[r, e + 1]
                r = r[up]
                best[r, e + 1], many[r, e + 1] = score[up], many[r, (e + 1 - s)[up]] + 1
                match[at] = trie.out[match[at]]
                at = at[match[at] > 0]
            k = np.flatnonzero(whole & ~single)
            if len(k):
                r = rows[k]
                score = best[r, begun[r]] + self.v.unknown_score
                up = score > best[r, e + 1]
                r = r[up]
                best[r, e + 1], many[r, e + 1] = score[up], many[r, begun[r]] + self._unknown_pieces(char[k][up])
        every = np.arange(n)
        return many[every, size], best[every, size]

    # -- decoding ---------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """Pieces end to end, markers as spaces, without the first space; each byte that isn't UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.v.surface.__getitem__, ids.tolist())).decode(errors="each").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(rows, first chunk of each text, distinct chunk of each chunk, (bytes, starts, sizes) of the distinct chunks or None), step by step."""
    for rows, buf, offs in text_steps(batches, step=_STEP):
        size = np.diff(offs)
        shift = np.concatenate([[0], np.cumsum(size > 0)])  # a space goes before each text that isn't empty
        at = offs + shift
        text = np.full(int(at[-1]), 0x20, dtype=np.uint8)
        text[np.arange(len(buf)) + np.repeat(shift[:-1] + 1, size)] = buf
        if not len(text):
            yield rows, np.zeros(len(rows) + 1, np.int64), np.zeros(0, np.int64), None
            continue
        space, line = text == 0x20, text == 0x0A
        edge = space.copy()
        edge[1:] &= ~space[:-1]
        marks = np.flatnonzero(text[:-3] == _MARK_BYTES[0]) if len(text) > 3 else np.zeros(0, np.int64)
        edge[marks[(text[marks + 1] == _MARK_BYTES[1]) & (text[marks + 2] == _MARK_BYTES[2])] + 3] = False  # a space after a marker goes on with it
        edge |= line
        edge[1:] |= line[:-1]
        edge[at[:-1][size > 0]] = True
        lo = np.flatnonzero(edge)
        hi = np.append(lo[1:], len(text))
        first, which = distinct(range_hashes(text, lo, hi, both=False)[0])
        yield rows, np.searchsorted(lo, at), which, (text, lo[first], hi[first] - lo[first])


def _groups(text: np.ndarray, lo: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which chunks, their bytes padded with spaces written as markers, their sizes): like sizes together, long ones alone."""
    marked = _marked_sizes(text, lo, size)
    order = np.argsort(marked, kind="stable")
    i = 0
    while i < len(order):
        if marked[order[i]] > LONG:
            j = i + 1
        else:
            j = i + min(16384, int(np.searchsorted(marked[order[i:]], min(LONG, 2 * marked[order[i]] + 8), side="right")))
        some = order[i:j]
        yield some, *_padded(text, lo[some], size[some], marked[some])
        i = j


def _marked_sizes(text: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    spaces = np.concatenate([[0], np.cumsum(text == 0x20)])
    return size + 2 * (spaces[lo + size] - spaces[lo])


_MARK_BYTES = np.frombuffer(MARK.encode(), dtype=np.uint8)


def _padded(text: np.ndarray, lo: np.ndarray, size: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    raw = text[at]
    many = np.where(raw == 0x20, 3, 1)
    ends = np.cumsum(many)
    out = np.repeat(raw, many)
    spots = (ends - 3)[raw == 0x20]
    out[spots[:, None] + np.arange(3)] = _MARK_BYTES
    pad = np.zeros((len(lo), int(marked.max())), dtype=np.uint8)
    row = np.repeat(np.arange(len(lo)), marked)
    pad[row, np.arange(len(out)) - np.repeat(np.cumsum(marked) - marked, marked)] = out
    return pad, marked.astype(np.int64)


_SOLVERS: dict[str, Solver] = {}


def solver(path: str) -> Solver:
    """Built once from the vocabulary file, on the driver; workers get it by a broadcast as large as the vocabulary."""
    if path not in _SOLVERS:
        _SOLVERS[path] = Solver(Vocabulary.load(path))
    return _SOLVERS[path]


def _shared(df: DataFrame, model: str):
    prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(solver(model))


def encode_texts(batches: Iterator[pa.RecordBatch], solve: Solver) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, all ids, where each row's begin)."""
    for rows, first, which, found in _chunks(batches):
        if found is None:
            yield rows, np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64)
            continue
        parts, many, order = [], np.zeros(len(found[1]), dtype=np.int64), []
        for some, pad, size in _groups(*found):
            ids, ptr = solve.encode(pad, size)
            parts.append(ids)
            many[some] = np.diff(ptr)
            order.append(some)
        ids, order = np.concatenate(parts), np.concatenate(order)
        begin = np.zeros(len(many), dtype=np.int64)
        begin[order] = np.cumsum(many[order]) - many[order]
        each = many[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(begin[which] - ends[:-1], each) + np.arange(int(ends[-1]))
        yield rows, ids[at], ends[first]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int>. Null and empty texts have no ids; other columns are ignored."""
    shared = _shared(docs, model)

    def run(batches):
        for rows, ids, ptr in encode_texts(batches, shared.value):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(ptr.astype(np.int32), ids)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id, text, of doc_id and ids. Null ids give a null text, none an empty one."""
    shared = _shared(tokens, model)

    def run(batches):
        decode = shared.value.decode
        for rows in batches:
            texts = [None if x is None else decode(np.array(x, dtype=np.int64)) for x in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256, same (decoding gave the text back).

    Null texts count as empty. A text that has U+2581 itself comes back with a space for it. One row for each row, a null
    doc_id included; repeated rows are encoded each. An empty table gives no rows.
    """
    shared = _shared(docs, model)

    def run(batches):
        solve = shared.value
        for rows, ids, ptr in encode_texts(batches, solve):
            out = []
            for i, text in enumerate(rows.column("text").to_pylist()):
                own = ids[ptr[i] : ptr[i + 1]]
                back = solve.decode(own)
                out.append((len(own), zlib.crc32(own.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            n, crc, sha, same = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")


def token_counts(docs: DataFrame, model: str, *also: str) -> DataFrame:
    """doc_id, n_tokens, score (of the best path), and the columns ``also``: what encode would give, without the ids. Null and empty texts have 0 tokens and score 0. One row for each row, a null doc_id included; repeated rows are counted each."""
    shared = _shared(docs, model)

    def run(batches):
        solve = shared.value
        for rows, first, which, found in _chunks(batches):
            n, score = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
            if found is not None:
                many, best = np.zeros(len(found[1]), dtype=np.int64), np.zeros(len(found[1]))
                for some, pad, size in _groups(*found):
                    many[some], best[some] = solve.count(pad, size)
                sums = [np.concatenate([[0], np.cumsum(x[which])]) for x in (many, best)]
                n, score = (np.diff(x[first]) for x in sums)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64()), *(rows.column(c) for c in also)], names=["doc_id", "n_tokens", "score", *also])

    docs = docs.select("doc_id", "text", *also)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in also)])
    return docs.mapInArrow(run, schema).select("doc_id", "n_tokens", (F.col("score") + 0.0).alias("score"), *also)
