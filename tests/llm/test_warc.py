"""Exact round trips through archives."""

import base64
import gzip
import hashlib
import re
from pathlib import Path

from trailmark.llm.warc import read_chunks, round_trip, write_archives

ODD = [
    "", None, "plain", "plain", "a\r\nb\r\n", "\r\n\r\n", "ends in cr\r", "\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nx", "é" * 5001,
    "\r\n" * 400, "日本\r\n語" * 300, "x" * 10_000, "x" * 10_000, "nul\0nul", "content-length: 7\r\n\r\nbody",
]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        first[h] = min(first.get(h, i), i)
    out = {}
    for i, _, h in rows:
        h = (h or "").encode()
        own = len(h) < least or first[h] == i
        out[i] = (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if own else "revisit", None if own else first[h])
    return out


def found(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_round_trip(spark):
    rows = [(7 * i % 101, f"http://x/ {i}\n", h) for i, h in enumerate(ODD)]
    for least in (0, 6):
        df = round_trip(pages_of(spark, rows), least, chunk_bytes=1000)
        assert found(df) == expected(rows, least)
    assert all(r.digest_matches for r in df.collect() if r.record_type == "response")


def test_chunks_carry_the_payload(spark, tmp_path):
    rows = [(i, None, h) for i, h in enumerate(ODD)]
    path = f"{tmp_path}/archives"
    write_archives(pages_of(spark, rows), path, chunk_bytes=999)
    parts = {}
    for r in read_chunks(spark, path).collect():
        parts.setdefault(r.page_id, []).append((r.chunk_number, r.chunk_bytes, r.payload_bytes, r.payload_digest, r.last, bytes(r.data), r.record_type))
    for i, _, h in rows:
        chunks = sorted(parts[i])
        if chunks[0][-1] == "revisit":
            continue
        data = b"".join(c[5] for c in chunks)
        assert data == (h or "").encode() and [c[0] for c in chunks] == list(range(1, len(chunks) + 1))
        assert max(c[1] for c in chunks) <= 999 and [c[4] for c in chunks] == [False] * (len(chunks) - 1) + [True]
        for k, c in enumerate(chunks):
            so_far = b"".join(x[5] for x in chunks[: k + 1])
            assert (c[2], c[3]) == (len(so_far), base64.b32encode(hashlib.sha1(so_far).digest()).decode())


def test_archives_are_well_formed(spark, tmp_path):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(ODD)]
    write_archives(pages_of(spark, rows), f"{tmp_path}/a", chunk_bytes=500)
    records = 0
    for file in Path(f"{tmp_path}/a").glob("part-*"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            head = re.match(rb"WARC/1\.1\r\n((?:[^\r\n]+\r\n)+)\r\n", data[at:])
            fields = dict(f.split(b": ", 1) for f in head[1].split(b"\r\n") if f)
            at += head.end() + int(fields[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at, records = at + 4, records + 1
    assert records > len(rows)


def test_edges(spark):
    assert round_trip(pages_of(spark, [])).collect() == []
    rows = [(None, None, None), (None, None, "x"), (4, None, "x"), (4, None, "x"), (5, "u", "x")]
    odd = pages_of(spark, rows).selectExpr("*", "1 as same", "2 as n", "3 as value", "4 as first_id")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in round_trip(odd).collect())
    assert got == [("4", 1, "response", "None"), ("4", 1, "response", "None"), ("5", 1, "revisit", "4"), ("None", 0, "response", "None"), ("None", 1, "revisit", "4")]
