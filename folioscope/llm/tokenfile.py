"""Token ids in binary files: ids in one array, document boundaries in Elias-Fano code.

A file holds a run of documents in ascending order of doc_id:

    ids              u little-endian unsigned integers
    lows             n + 1 values of l bits each, packed from the lowest bit, in 64-bit words
    highs            h 64-bit words: boundary i sets bit (boundary i >> l) + i
    select           s unsigned 32-bit integers: the word of highs that has set bit 0, 256, 512, ...
    inner            s bytes: how many set bits that word has before it
    doc ids          n signed 64-bit integers
    footer           6 unsigned 64-bit integers: bytes of an id (2 or 4), documents n, ids u, low bits l, h, s
    magic            8 bytes   b"FSTOKEF1"

Boundary i is the number of ids before document i; boundary n is u. A boundary takes about 2 + log2(u / n) bits, and
the select table 0.16 bits more. No 64-bit table of offsets is kept.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, distinct, partitions, prepare, text_steps
from .suffix import range_hashes

MAGIC = b"FSTOKEF1"
EVERY = 256


@dataclass
class EliasFano:
    """A nondecreasing sequence of n values; at(i) selects one from the code, all() decodes."""

    low_bits: int
    lows: np.ndarray
    highs: np.ndarray
    select: np.ndarray
    inner: np.ndarray
    n: int

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        v = values.astype(np.uint64)
        lows = np.zeros((n * low_bits + 63) // 64 + 1, dtype=np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.int64) * low_bits
            low = v & np.uint64((1 << low_bits) - 1)
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(lows, at >> 6, low << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(lows, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        word = place >> 6
        highs = np.zeros(int(word[-1]) + 1, dtype=np.uint64)
        np.bitwise_or.at(highs, word, np.uint64(1) << (place & 63).astype(np.uint64))
        inner = np.arange(n) - np.searchsorted(word, word)
        return EliasFano(low_bits, lows, highs, word[::EVERY].astype(np.uint32), inner[::EVERY].astype(np.uint8), n)

    def at(self, i: int) -> int:
        word = int(self.select[i // EVERY])
        left = int(self.inner[i // EVERY]) + i % EVERY
        bits = int(self.highs[word])
        while left >= (many := bits.bit_count()):
            left, word = left - many, word + 1
            bits = int(self.highs[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        at = i * self.low_bits
        word, shift = at >> 6, at & 63
        both = int(self.lows[word]) | int(self.lows[word + 1]) << 64 if word + 1 < len(self.lows) else int(self.lows[word])
        return both >> shift & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value, word by word."""
        bits = np.unpackbits(self.highs.view(np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        at = np.arange(self.n, dtype=np.int64) * self.low_bits
        shift = (at & 63).astype(np.uint64)
        low = self.lows[at >> 6] >> shift
        over = np.flatnonzero((at & 63) + self.low_bits > 64)
        low[over] |= self.lows[(at[over] >> 6) + 1] << (np.uint64(64) - shift[over])
        return high << self.low_bits | (low & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


def write_file(fs: pafs.FileSystem, path: str, rows: Iterator[tuple[np.ndarray, list[bytes]]], width: int) -> tuple[int, int]:
    """``rows``: (doc_ids, each document's ids as bytes), batch by batch; only the boundaries stay in memory. Returns (documents, ids)."""
    doc_ids, sizes = [], []
    with fs.open_output_stream(path) as out:
        for some, ids in rows:
            doc_ids.append(some)
            sizes += [len(x) // width for x in ids]
            out.write(b"".join(ids))
        bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        for part in (bounds.lows, bounds.highs, bounds.select, bounds.inner, np.concatenate(doc_ids).astype("<i8")):
            out.write(part.tobytes())
        out.write(np.array([width, len(sizes), sum(sizes), bounds.low_bits, len(bounds.highs), len(bounds.select)], dtype="<u8").tobytes() + MAGIC)
    return len(sizes), sum(sizes)


class TokenFile:
    """Reads a file; ids are fetched by range, so a document costs its own bytes."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        foot = self.file.read_at(56, self.file.size() - 56)
        if foot[48:] != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        self.width, self.n, self.ids, low, highs, many = (int(x) for x in np.frombuffer(foot, dtype="<u8", count=6))
        at, parts = self.ids * self.width, []
        for count, kind in ((((self.n + 1) * low + 63) // 64 + 1, "<u8"), (highs, "<u8"), (many, "<u4"), (many, "u1"), (self.n, "<i8")):
            size = count * np.dtype(kind).itemsize
            parts.append(np.frombuffer(self.file.read_at(size, at), dtype=kind))
            at += size
        self.bounds, self.doc_ids = EliasFano(low, *parts[:4], self.n + 1), parts[4]

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file's array."""
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), dtype=f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.read(self.bounds.at(i), self.bounds.at(i + 1))


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_OTHER_SPACE = np.zeros(256, dtype=bool)
_OTHER_SPACE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def _odd(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts have white space beside white space, or any that is neither a space nor a line feed."""
    plain = (buf == 0x20) | (buf == 0x0A)
    bad = _OTHER_SPACE[buf]
    bad[1:] |= plain[1:] & plain[:-1]
    bad[offs[:-1][offs[:-1] < len(buf)]] &= ~plain[offs[:-1][offs[:-1] < len(buf)]]
    lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    if len(lead):
        wide = np.append(buf, [0, 0])
        x, y, z = wide[lead], wide[lead + 1], wide[lead + 2]
        bad[lead] |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        bad[lead] |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
        bad[lead] |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        bad[lead] |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
        bad[lead] |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
    seen = np.concatenate([[0], np.cumsum(bad)])
    return seen[offs[1:]] > seen[offs[:-1]]


def _piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places that no token spans: texts' starts, before spaces, around line feeds, before a comma or full stop that follows a letter or digit."""
    edge = (buf == 0x20) | (buf == 0x0A)
    edge[1:] |= buf[:-1] == 0x0A
    point = np.flatnonzero((buf == 0x2C) | (buf == 0x2E))
    point = point[point >= 2]
    one, two = buf[point - 1], buf[point - 2]
    edge[point[_ALNUM[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]] = True
    edge[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(edge)


class WordCachedEncoder:
    """Encodes with the tokenizers library; pieces of text that can't share a token are encoded once and kept.

    The byte-level pre-tokenizer never joins a character that isn't white space to a space or line feed after it, nor a
    letter or digit to a comma or full stop, and splits before a space that a character follows, and around a lone line
    feed. Texts with other white space, or with white space beside white space, go to the library whole. Of the pieces of
    one step each different one is looked up once. The cache is bounded. ``literal``: added tokens that a text spells out
    are plain text; otherwise they are what the loaded tokenizer makes of them, and texts that hold one go to it whole.
    """

    def __init__(self, path: str, end: int, most: int = 1_300_000, literal: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if literal:
            self.tokenizer.encode_special_tokens = True
        self.added = [] if literal else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.end, self.most, self.known = np.array([end], dtype=f"<u{self.width}").tobytes(), most, {}

    def _library(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.width == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _looked_up(self, raw: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        keys = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
        known = self.known
        new = [k for k in keys if k not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = keys
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            known.update(zip(some, self._library([k.decode() for k in some]), strict=True))
        return [known[k] for k in keys]

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The ids of each text laid end to end at ``offs``, the end id after them, as bytes."""
        odd = _odd(buf, offs)
        raw = buf.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offs, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        out: list = [self.end] * (len(offs) - 1)
        for i, ids in zip(np.flatnonzero(odd).tolist(), self._library([buf[offs[i] : offs[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]), strict=True):
            out[i] = ids + self.end
        lo = _piece_starts(buf, offs)
        if not len(lo):
            return out
        hi = np.append(lo[1:], len(buf))
        use = ~odd[np.searchsorted(offs, lo, side="right") - 1]
        lo, hi = lo[use], hi[use]
        if not len(lo):
            return out
        first, which = distinct(range_hashes(buf, lo, hi, both=False)[0])
        found = self._looked_up(raw, lo[first], hi[first])
        pool = np.frombuffer(b"".join(found), dtype=f"<u{self.width}")
        many = np.array([len(x) for x in found]) // self.width
        begin, each = np.cumsum(many) - many, many[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(begin[which] - ends[:-1], each) + np.arange(int(ends[-1]))]
        at = ends[np.searchsorted(lo, offs)]
        for i in np.flatnonzero(~odd & (offs[:-1] < offs[1:])).tolist():
            out[i] = ids[at[i] : at[i + 1]].tobytes() + self.end
        return out


_ENCODERS: dict[tuple[str, int], WordCachedEncoder] = {}


def cached_encoder(path: str, end: int) -> WordCachedEncoder:
    """One encoder a worker, so that its cache outlives a task."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = WordCachedEncoder(path, end, literal=False)
    return _ENCODERS[path, end]


def write_tokens(docs: DataFrame, folder: str, encoder: Callable[[], WordCachedEncoder], files: int) -> list[tuple[str, int]]:
    """Writes (doc_id, text) rows as token files in ascending order of doc_id; returns (path, ids) in that order.

    Each task writes under a name of its own, and only the names that finished tasks report count, so a task may be run
    again. The report has one row a file.
    """

    def run(batches):
        encode, first = encoder(), []

        def rows():
            for part, buf, offs in text_steps(batches, step=8 << 20):
                ids = part.column("doc_id").to_numpy()
                first[:] = first or [int(ids[0])]
                yield ids, encode(buf, offs)

        some = rows()
        head = next(some, None)
        if head:
            fs, base = _file_system(folder)
            fs.create_dir(base, recursive=True)
            place = f"part-{uuid.uuid4().hex}.tok"
            _, ids = write_file(fs, f"{base}/{place}", chain([head], some), encode.width)
            yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array(first), pa.array([ids], pa.int64())], names=["file", "first", "ids"])

    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    report = ordered.mapInArrow(run, "file string, first long, ids long").collect()
    return [(r["file"], r["ids"]) for r in sorted(report, key=lambda r: (r["first"], r["file"]))]


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    starts = np.concatenate([[0], np.cumsum([n for _, n in files])]).tolist()
    schema = "file string, start long"
    table = spark.createDataFrame([(f, int(s)) for (f, _), s in zip(files, starts[:-1], strict=True)], schema).repartition(max(len(files), 1))

    def run(batches):
        fs, base = _file_system(folder)
        for rows in batches:
            for place, start in zip(rows.column("file").to_pylist(), rows.column("start").to_pylist(), strict=True):
                f = TokenFile(fs, f"{base}/{place}")
                bounds = f.bounds.all()
                for i in range(0, f.n, 500):
                    j = min(i + 500, f.n)
                    ids, b = f.read(int(bounds[i]), int(bounds[j])).astype("<u4"), bounds[i : j + 1] - bounds[i]
                    crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(b[:-1], b[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids[i:j]), pa.array(bounds[i:j] + start), pa.array(np.diff(b)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as token files with the tokenizer at path ``tokenizer`` and returns what read_tokens finds in them.

    Null texts are empty; an empty text is its end id alone. Rows without a doc_id are left out; rows that share one
    each have their place, ordered by text. Other columns are ignored. An empty table gives no files and no rows.
    ``folder`` must be one that driver and executors share; by default it lies under spark.checkpoint.dir.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or Scratch(spark, "tokens").base
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    files = write_tokens(docs, folder, lambda: cached_encoder(tokenizer, end), partitions(spark))
    return read_tokens(spark, folder, files)
