import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch
from folioscope.llm.warc import Source, WarcConfig, base32, captures, read_archives, record, round_trip, salvage, write_archives

SCHEMA = "page_id long, url string, html string, first string, key string, n long"


def pages(spark):
    rows = [(3, "http://a/é b", "<p>one</p>"), (1, "u1", "<p>one</p>"), (2, None, None), (4, "u\r\nX: y", ""), (5, "u5", "x" * 3_000_000), (6, "u6", "WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"), (7, "u7", "日本 \x00\r\n\r\n"), (None, "n", "<p>one</p>"), (None, "n", "alone"), (8, "u8", "<p>two</p>"), (8, "u8", "<p>two</p>"), (9, "u9", "<p>two</p>")]
    return spark.createDataFrame([(*r, "f", "k", 1) for r in rows], SCHEMA)


def plain(rows, least):
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None) if len(b) >= least else page
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("cfg", [WarcConfig(), WarcConfig(member=False, archive=1000), WarcConfig(least=11, archive=1)])
def test_round_trip(spark, cfg):
    table = pages(spark)
    rows = [(r["page_id"], r["url"], r["html"]) for r in table.collect()]
    got = round_trip(table.repartition(3), cfg).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows, cfg.least)
    assert {r["target_uri"] for r in got if r["page_id"] in (2, 3, 4)} == {None, "http://a/é%20b", "u%0D%0AX:%20y"}


def test_hot_payloads_and_empty_table(spark):
    table = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("html"))
    rows = [tuple(r) for r in table.collect()]
    assert sorted((tuple(r)[:5] for r in round_trip(table).collect()), key=str) == plain(rows, 0)
    assert round_trip(table.where("false")).collect() == []


def test_payloads_come_back(spark):
    scratch = Scratch(spark, "warc-test")
    table = pages(spark)
    archives = write_archives(captures(table, scratch), f"{scratch.base}/a", scratch, WarcConfig(archive=5000))
    assert archives.agg(F.sum("records")).first()[0] == table.count()
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in read_archives(archives, f"{scratch.base}/a").where("record_type = 'response'").collect() if r["page_id"] not in (None, 8)}
    want = {r["page_id"]: r["html"] or "" for r in table.collect()}
    assert got == {k: want[k] for k in (1, 2, 5, 6, 7)}
    scratch.clear()


def archive(member, n=40):
    r = random.Random(n)
    raw, spans, at = [], [], 0
    for i in range(n):
        html = bytes(r.randrange(256) for _ in range(r.randrange(0, 900))) + b"<p>" * r.randrange(50)
        x = record(i, f"http://x/{i}", html, base32(hashlib.sha1(html).digest()), None, False, "2024-01-01T00:00:00Z")
        x = gzip.compress(x, 6, mtime=0) if member else x
        raw.append(x)
        spans.append((at, at + len(x)))
        at += len(x)
    return b"".join(raw), spans


def read(data):
    rows = list(salvage(Source(io.BytesIO(data), len(data))))
    at = 0
    for offset, length, got, reason in rows:  # records and gaps tile the file
        if length:
            assert offset == at
            at += length
        assert (got is None) == (reason is not None)
    assert at == len(data)
    whole = [g for _, _, g, _ in rows if g and not g["salvaged"]]  # a plain record's headers have no checksum, so their damage may pass
    return [int(g["page-id"]) for g in whole if g.get("page-id", "").isdigit()], [(o, n, why) for o, n, _, why in rows if why]


@pytest.mark.parametrize("member", [True, False])
def test_salvage(member):
    data, spans = archive(member)
    assert read(data) == (list(range(40)), [])
    r = random.Random(1)
    for _ in range(60):
        hurt, hit = bytearray(data), set()
        for _ in range(r.randrange(1, 4)):
            i = r.randrange(40)
            lo, hi = spans[i]
            place = r.randrange(lo, hi - 8)
            hurt[place : place + 4] = bytes(b ^ 0x5A for b in hurt[place : place + 4])
            hit |= {k for k, (x, y) in enumerate(spans) if x < place + 4 and y > place}
        found, gaps = read(bytes(hurt))
        assert set(range(40)) - hit <= set(found) and (not member or found == sorted(set(range(40)) - hit))
        assert all(any(o < spans[k][1] and o + n > spans[k][0] for k in hit) for o, n, _ in gaps)


@pytest.mark.parametrize("member", [True, False])
def test_salvage_of_cut_and_foreign_bytes(member):
    data, spans = archive(member)
    a, b, c = spans[10][0], spans[20][0], spans[30][0]
    junk = b"\x1f\x8b\x08 no member WARC/1.1\r\nWARC/1.0 nothing " * 9
    mixed = data[5:a] + junk + data[a:b] + data[b + 30 : c] + data[c : spans[35][1] - 3]
    found, gaps = read(mixed)
    assert found == [*range(1, 20), *range(21, 35)] and len(gaps) == 4
    assert read(b"") == ([], []) and read(b"nothing here")[0] == [] and read(junk)[0] == []
    cut = data[: spans[35][0] + 12]
    assert read(cut)[0] == list(range(35)) and read(cut)[1][0][0] == spans[35][0]


@pytest.mark.parametrize("level", [0, 6])
def test_records_before_the_damage_in_a_member(level):
    """Without compression the records behind the damage stand in the file as they are, and are found as well."""
    texts = [random.Random(i).randbytes(3000) for i in range(6)]
    parts = [record(i, "u", x, base32(hashlib.sha1(x).digest()), None, False, "2024-01-01T00:00:00Z") for i, x in enumerate(texts)]
    whole = gzip.compress(b"".join(parts), level, mtime=0)  # many records in one member
    assert read(whole) == (list(range(6)), [])
    hurt = bytearray(whole)
    hurt[len(whole) * 7 // 12] ^= 1  # in the fourth
    rows = list(salvage(Source(io.BytesIO(bytes(hurt)), len(hurt))))
    kept = sorted((int(g["page-id"]), g["salvaged"]) for _, _, g, _ in rows if g)
    if level:
        assert kept[:3] == [(0, True), (1, True), (2, True)] and len(kept) < 6
    else:
        assert kept == [(i, False) for i in (0, 1, 2, 4, 5)]
