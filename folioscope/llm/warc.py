"""WARC archives: a writer that records equal payloads once, and a reader that salvages damaged archives.

A page becomes a record of an HTTP response, or a revisit that names the response with the same payload. Archives have
one gzip member a record, or plain records, and are closed once they reach a size.

The reader checks what it reads: the member's checksum, the version line, headers, length and end of the record, and the
digests of block and payload. Where a check fails it searches for the next place at which a member or a version line
passes all checks, goes on from there, and logs the bytes between as a quarantined gap. Records and gaps tile a file. Of a
damaged member, records that come before the damage and prove themselves by a digest are recovered as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, Scratch, partitions, prepare
from .tokenfile import _file_system

_CHUNK = 1 << 20
#: Bytes that a record's headers have at most.
_HEAD = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


@dataclass(frozen=True)
class WarcConfig:
    """least: payloads of fewer bytes are never revisits. archive: bytes after which an archive is closed. member: one gzip member a record, or plain records. level: of the compression. date: WARC-Date of every record."""

    least: int = 0
    archive: int = 32 << 20
    member: bool = True
    level: int = 5
    date: str = "2024-01-01T00:00:00Z"


class Damage(Exception):
    """A check that failed; the message names it."""


# -- writing ------------------------------------------------------------------------------------------------------------


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def _line(value: str) -> str:
    """A header's value: characters that would end it or can't stand in it are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The bytes of a record; a revisit has the HTTP head alone, which tells the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = block if revisit else block + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url else []
    head += [f"Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def captures(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """page_id, url, payload, key (hex SHA-1 and a second hash), first (the page whose record the others of the same payload revisit).

    Payloads are matched by key; those that more than one in HEAVY of all rows have are broadcast, with 1,000 at most, so
    that none gathers its rows in one task.
    """
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("key", F.concat(F.sha1("payload"), F.hex(F.xxhash64("payload"))))
    seen = rows.where(F.length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = scratch.keep(seen.where("n > 1"), "again")
    total, most = again.agg(F.sum("n"), F.max("n")).first()
    heavy = F.col("n") * HEAVY > (total or 0)
    hot = F.broadcast(again.where(heavy).select("key", F.col("first").alias("hot"), F.lit(True).alias("known")))
    rows = rows.join(hot, "key", "left")
    # Rows of a known payload, and those too small to be revisits, get a key of their own: they match nothing and spread.
    open_ = F.col("known").isNull() & (F.length("payload") >= least)
    rows = rows.withColumn("match", F.when(open_, F.col("key")).otherwise(F.concat_ws("#", F.lit(""), F.col("page_id"), F.xxhash64("url"))))
    rest = again.where(~heavy).select(F.col("key").alias("match"), F.col("first").alias("own"), F.lit(True).alias("found"))
    rows = rows.join(rest, "match", "left")
    first = F.when(F.col("known"), F.col("hot")).when(F.col("found"), F.col("own")).otherwise(F.col("page_id"))
    return rows.select("page_id", "url", "payload", "key", first.alias("first"))


def write_archives(rows: DataFrame, folder: str, scratch: Scratch, cfg: WarcConfig | None = None) -> DataFrame:
    """Writes a record for each row of ``captures`` and returns the archives: archive, bytes, records.

    A task writes under names of its own, and only archives that finished tasks report count, so a task may run again.
    """
    cfg = cfg or WarcConfig()

    def run(batches):
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        size = n = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "key", "first")]
            for page_id, url, payload, key, first in zip(*columns, strict=True):
                page_id, url, payload, key, first = page_id.as_py(), url.as_py(), payload.as_py(), key.as_py(), first.as_py()
                raw = record(page_id, url, payload, base32(bytes.fromhex(key[:40])), first, page_id != first, cfg.date)
                raw = gzip.compress(raw, cfg.level, mtime=0) if cfg.member else raw
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc{'.gz' if cfg.member else ''}", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= cfg.archive:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], names=["archive", "bytes", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], names=["archive", "bytes", "records"])

    return scratch.keep(rows.mapInArrow(run, "archive string, bytes long, records long"), "archives")


# -- reading ------------------------------------------------------------------------------------------------------------


class Source:
    """Bytes of an open file by place; holds a block of it at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.file.seek(at)
            self.at, self.block = at, self.file.read(max(n, _CHUNK))
        return self.block[at - self.at : at - self.at + n]

    def candidate(self, at: int) -> int:
        """The first place from ``at`` on where a member or a version line may begin, or the end."""
        while at < self.size:
            block = self(at, _CHUNK)
            hit = _START.search(block)
            if hit:
                return at + hit.start()
            at += max(len(block) - 6, 1) if at + len(block) < self.size else len(block)
        return self.size


def parse(read: Callable[[int, int], bytes], at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises Damage. A record has its headers by lower-case name, ``block``, ``payload`` and ``proved`` (a digest was there to check)."""
    head, size = b"", 4096
    while b"\r\n\r\n" not in head:
        if len(head) >= _HEAD or head and len(head) < size // 2:
            raise Damage("headers don't end")
        head, size = read(at, size), size * 2
        if not _VERSION.match(head):
            raise Damage("no version line")
    head = head[: head.index(b"\r\n\r\n")]
    out: dict = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise Damage("a header can't be read")
        out[name.decode(errors="replace").lower()] = value.strip().decode(errors="replace")
    length = out.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", length):
        raise Damage("no length")
    begin = at + len(head) + 4
    block, end = read(begin, int(length)), read(begin + int(length), 4)
    if len(block) < int(length):
        raise Damage("cut off")
    if end != b"\r\n\r\n":
        raise Damage("no end of record")
    http, _, payload = block.partition(b"\r\n\r\n") if out.get("warc-type") in ("response", "revisit") else (b"", b"", block)
    out |= {"block": block, "payload": payload, "http": http, "proved": False}
    whole = ("warc-payload-digest",) if out.get("warc-type") != "revisit" else ()
    for name in ("warc-block-digest", *whole):
        kind, _, want = out.get(name, "").partition(":")
        if kind.lower() == "sha1":
            if base32(hashlib.sha1(block if name == "warc-block-digest" else payload).digest()) != want.upper():
                raise Damage(f"{name} doesn't match")
            out["proved"] = True
    return out, begin + int(length) + 4


def _inflated(src: Source, at: int) -> tuple[bytes, int, str]:
    """(content, end, what is wrong) of the member at ``at``; of a damaged member what could be read of it, and the end -1."""
    inflate, parts, place = zlib.decompressobj(31), [], at
    while not inflate.eof:
        step = src(place, 1 << 16)
        if not step:
            return b"".join(parts), -1, "member is cut off"
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(step))
        except zlib.error:  # what comes before the damage, nearly to the byte
            try:
                for k in range(0, len(step), 64):
                    parts.append(before.decompress(step[k : k + 64]))
            except zlib.error:
                pass
            return b"".join(parts), -1, "member is damaged"
        place += len(step)
        if len(parts) == 1 and not b"WARC/".startswith(parts[0][:5]) and not parts[0].startswith(b"WARC/"):
            return b"", -1, "member holds no record"
    return b"".join(parts), place - len(inflate.unused_data), ""


def salvage(src: Source) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) of each record, (offset, length, None, reason) of each gap, in file order.

    The length of a record in a member is the member's where it is alone in it, else 0 for all but the first; records
    that were recovered from a damaged member have length 0, for its bytes belong to the gap, and ``salvaged``. Those of
    them that also stand in the file as they are (a member may store without compressing) come once, as plain records.
    """
    at, bad, why, saved = 0, -1, "", {}
    while at < src.size:
        start, records, reason, end = at, [], "", -1
        member = src(at, 3) == b"\x1f\x8b\x08"
        if member:
            content, end, reason = _inflated(src, at)
            read, place = (lambda i, n: content[i : i + n]), 0  # noqa: B023
            try:
                while place < len(content):
                    got, place = parse(read, place)
                    records.append(got)
            except Damage as e:
                reason = reason or str(e)
        else:
            try:
                got, end = parse(src, at)
                records.append(got)
            except Damage as e:
                reason = str(e)
        if not reason and records:
            if bad >= 0:
                yield bad, start - bad, None, why
                bad = -1
            if member:
                yield from saved.values()
                saved = {}
            for k, got in enumerate(records):
                saved.pop(got.get("warc-record-id"), None)
                yield start, 0 if k else end - start, got | {"salvaged": False}, None
            at = end
            continue
        if bad < 0:
            bad, why = start, reason or "empty member"
        saved |= {got.get("warc-record-id") or (start, k): (start, 0, got | {"salvaged": True}, None) for k, got in enumerate(records) if got["proved"]}
        at = end if end > start else src.candidate(start + 1)
    if bad >= 0:
        yield bad, src.size - bad, None, why
    yield from saved.values()


READ = "archive string, offset long, length long, reason string, salvaged boolean, record_id string, record_type string, page_id long, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"


def _number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch("-?[0-9]{1,18}", value) else None


def _row(name: str, offset: int, length: int, got: dict | None, reason: str | None, payloads: bool) -> tuple:
    if got is None:
        return name, offset, length, reason, *[None] * 9
    revisit = got.get("warc-type") == "revisit"
    size = len(got["payload"])
    if revisit:
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})", got["http"])
        size = int(told[1]) if told else None
    digest = got.get("warc-payload-digest", "").partition(":")[2].upper() or (None if revisit else base32(hashlib.sha1(got["payload"]).digest()))
    return name, offset, length, None, got["salvaged"], got.get("warc-record-id"), got.get("warc-type"), _number(got.get("page-id")), _number(got.get("refers-to-page-id")), got.get("warc-target-uri"), size, digest, got["payload"] if payloads and not revisit else None


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records and the gaps (``reason`` isn't null) of ``archives`` (archive: a name in ``folder``); see READ for the columns.

    payload_bytes and payload_digest are the full payload's, of revisits too. Without ``payloads`` their bytes stay behind. A task
    holds one record at a time, and about a megabyte of rows. Archives that are empty give no rows; those that are missing are an error.
    """
    prepare(archives.sparkSession)

    def run(batches):
        fs, base = _file_system(folder)
        names = [c.split()[0] for c in READ.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in READ.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for some in batches:
            for name in some.column("archive").to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{name}") as file:
                    for found in salvage(Source(file, file.size())):
                        rows.append(_row(name, *found, payloads))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= 1000 or held >= _CHUNK:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("archive").repartition(partitions(archives.sparkSession)).mapInArrow(run, READ)


def round_trip(pages: DataFrame, cfg: WarcConfig | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and returns what is read back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Of the rows with an equal payload (null html: empty) of cfg.least bytes or more, those with the smallest page_id are
    responses and the others revisit it; rows that repeat a page_id and its payload are the same capture, of one kind and
    record id. A null page_id comes after all others and is read back as null. Null urls have no target. Other columns
    are ignored; an empty table gives no rows. Archives that don't read back whole are an error.
    """
    cfg = cfg or WarcConfig()
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.base}/archives"
    archives = write_archives(captures(pages, scratch, cfg.least), folder, scratch, cfg)
    rows = scratch.keep(read_archives(archives, folder, payloads=False), "read")
    gaps = rows.where("reason is not null").select("archive", "offset", "length", "reason").take(5)
    if gaps:
        raise RuntimeError(f"archives are damaged: {gaps}")
    return rows.where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
