"""WARC archives written and read as tables of record chunks."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import attach, written
from trailmark.session import scratch_path

CHUNK_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
PAYLOADS = "page_id long, url string, html string, payload_bytes long, payload_digest string"
CHUNKS = (
    "page_id long, record_type string, refers_to long, chunk_number int, chunk_bytes long, payload_bytes long,"
    " payload_digest string, last boolean, digest_matches boolean, data binary"
)
ARROW_CHUNKS = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_number", pa.int32()),
     ("chunk_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()),
     ("digest_matches", pa.bool_()), ("data", pa.binary())]
)


def base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def payload(value: pa.Scalar) -> memoryview:
    """The bytes of a string value, without a copy; none for null."""
    held = value.cast(pa.large_binary()).as_buffer() if value.is_valid else None
    return memoryview(held) if held is not None else memoryview(b"")


def pieces(data: memoryview, size: int) -> Iterator[memoryview]:
    """Parts of at most ``size`` bytes that end between characters; one empty part for nothing."""
    a = 0
    while True:
        b = min(len(data), a + size)
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        yield data[a:b]
        a = b
        if a >= len(data):
            return


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, shas = [], []
        for value in batch["html"]:
            data, sha = payload(value), hashlib.sha1()
            for part in pieces(data, CHUNK_BYTES):
                sha.update(part)
            sizes.append(len(data))
            shas.append(base32(sha))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], names=[*batch.schema.names, "payload_bytes", "payload_digest"])


def address(page_id: int | None, segment: int = 1) -> str:
    return f"<urn:pages:{'null' if page_id is None else page_id}{f':{segment}' if segment > 1 else ''}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    # The writer ends each row with the second line end that closes a record.
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def segments(row: dict, data: memoryview, date: str, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response whose payload goes on in continuations."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    common = [("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
    http_type = ("Content-Type", "application/http; msgtype=response")
    if row["record_type"] == "revisit":
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        refers = ("WARC-Refers-To", address(row["refers_to"]))
        yield record("revisit", [("WARC-Record-ID", address(row["page_id"])), *common, profile, refers, http_type], http)
        return
    count = sum(1 for _ in pieces(data, chunk_bytes))
    for number, part in enumerate(pieces(data, chunk_bytes), 1):
        fields = [("WARC-Record-ID", address(row["page_id"], number)), *common]
        if count > 1:
            fields.append(("WARC-Segment-Number", str(number)))
        if number == 1:
            yield record("response", [*fields, http_type], http + part)
        else:
            fields.append(("WARC-Segment-Origin-ID", address(row["page_id"])))
            if number == count:
                fields.append(("WARC-Segment-Total-Length", str(len(http) + len(data))))
            yield record("continuation", fields, bytes(part))


def records(date: str, chunk_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            html = batch["html"]
            other = batch.drop_columns(["html"])
            for i in range(batch.num_rows):
                row = {c: other[c][i].as_py() for c in other.schema.names}
                for value in segments(row, payload(html[i]), date, chunk_bytes):
                    rows.append(value)
                    held += len(value)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], names=["value"])
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], names=["value"])

    return write


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Every page with its payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of ``least_bytes`` or more, the one with the smallest page_id is the response. A
    digest with a third of the rows is not gathered: its rows get the answer by broadcast.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sent = rows.mapInArrow(digests, PAYLOADS).withColumn("same", F.struct("payload_digest", "payload_bytes"))
    groups = sent.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
    groups = written(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    met = attach(sent, groups, "same", "n", total, F.col("page_id")).drop("same")
    response = (F.col("payload_bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("first_id")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES
) -> None:
    """Writes a WARC record per row of (page_id, url, html) into compressed archives under ``path``.

    A payload above ``chunk_bytes`` is cut between characters into a response and continuation records
    numbered by WARC-Segment-Number, all in one archive and in order. Records leave one at a
    time; no more than a few MB wait. A null html is an empty payload, a null url leaves its field out,
    a null page_id has the address ``null``. Rows that repeat an id and its payload are all responses.
    """
    decided(pages, least_bytes).mapInArrow(records(date, chunk_bytes), "value string").write.option("lineSep", "\r\n").option(
        "compression", "gzip"
    ).text(path)


class Reader:
    """Follows the lines of an archive; gives a row per chunk, with the digest of the payload so far."""

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.fields: dict[str, str] | None = None
        self.left = 0
        self.in_http = False
        self.open: dict | None = None

    def line(self, line: bytes) -> Iterator[dict]:
        if self.left:
            self.block(line)
            if not self.left:
                self.fields = None
            return
        if self.fields is None:
            if line.startswith(b"WARC/"):
                self.fields = {}
            return
        if line:
            name, _, value = line.decode().partition(": ")
            self.fields[name] = value
            return
        yield from self.begin()

    def begin(self) -> Iterator[dict]:
        fields, self.left = self.fields, int(self.fields["Content-Length"])
        if fields["WARC-Type"] == "continuation":
            yield self.row(last=False)
            self.open |= {"number": self.open["number"] + 1, "size": 0, "data": bytearray()}
        else:
            yield from self.end()
            where = lambda v: None if v in (None, "<urn:pages:null>") else int(v.split(":")[2].rstrip(">"))
            self.open = {
                "page_id": where(fields["WARC-Record-ID"]), "kind": fields["WARC-Type"], "refers": where(fields.get("WARC-Refers-To")),
                "told": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "sha": hashlib.sha1(), "total": 0, "size": 0,
                "number": 1, "data": bytearray(), "length": 0,
            }
            self.in_http = True
        if not self.left:
            self.fields = None

    def block(self, line: bytes) -> None:
        if self.left > len(line):
            # The line end belongs to the block.
            self.left -= len(line) + 2
            part = line + b"\r\n"
        else:
            self.left -= len(line)
            part = line
        if self.in_http:
            if line.lower().startswith(b"content-length:"):
                self.open["length"] = int(line.split(b":")[1])
            self.in_http = line != b""
            return
        o = self.open
        o["sha"].update(part)
        o["total"] += len(part)
        o["size"] += len(part)
        if self.with_data:
            o["data"] += part

    def row(self, last: bool) -> dict:
        o = self.open
        read = o["kind"] == "response"
        return {
            "page_id": o["page_id"], "record_type": o["kind"], "refers_to": o["refers"], "chunk_number": o["number"], "chunk_bytes": o["size"],
            "payload_bytes": o["total"] if read else o["length"], "payload_digest": base32(o["sha"]) if read else o["told"], "last": last,
            "digest_matches": (base32(o["sha"]) == o["told"] and o["total"] == o["length"]) if read and last else None,
            "data": bytes(o["data"]) if self.with_data else None,
        }

    def end(self) -> Iterator[dict]:
        if self.open:
            yield self.row(last=True)
        self.open = None


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """A row per record and chunk of the archives under ``path``, in order inside an archive.

    payload_bytes and payload_digest cover the chunks up to this one; for the ``last`` chunk they are
    the record's own, and digest_matches compares them with its header. An archive is read line by line
    in one task; a record is never held whole, only the chunk at hand.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, held = Reader(with_data), [], 0
        for batch in batches:
            for value in batch["value"]:
                for row in reader.line(bytes(payload(value))):
                    rows.append(row)
                    held += row["chunk_bytes"] + 200
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_CHUNKS)
                    rows, held = [], 0
        rows += reader.end()
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW_CHUNKS)

    return spark.read.option("lineSep", "\r\n").text(path).mapInArrow(read, CHUNKS)


def round_trip(pages: DataFrame, least_bytes: int = 0, **options) -> DataFrame:
    """Archives the pages in the shared folder and reads every record back: its last chunk's row."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, least_bytes, **options)
    return read_chunks(spark, path, with_data=False).where("last")
