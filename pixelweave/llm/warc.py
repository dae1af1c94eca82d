"""WARC records in seekable Zstandard bundles.

A bundle (``.warc.zst``) is a run of independent Zstandard frames, each with some whole WARC records; a skippable
frame with the index of records; and the seek table of the public seekable format, a skippable frame that ends the file:
``zstd -d`` gives the plain WARC file, and a reader of that format finds any frame. The index maps a record's identifier
to its frame and its offset inside that frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the Zstandard formats.
SKIP_INDEX = 0x184D2A5D
SKIP_SEEK_TABLE = 0x184D2A5E
CLOSING = struct.pack("<I", 0x8F92EAB1)

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 48 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    value = identifier.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with the payload as an HTTP body, or a revisit with the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers in lower case, block, place after the record) of the record at ``at``."""
    data = bytes(data)
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    begin = end + 4
    stop = begin + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, data[begin:stop], stop + 4


class Bundle:
    """Collects records; ``finish`` gives the file's bytes but for the closing ones."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames, self.sizes, self.index, self.open, self.size, self.held = [], [], [], [], 0, 0

    def add(self, identifier: str, record: bytes) -> None:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._close()
        self.index.append((identifier, len(self.frames), self.size, len(record)))
        self.open.append(record)
        self.size += len(record)
        self.held += len(record)

    def _close(self) -> None:
        frame = self.zstd.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.size))
        self.open, self.size = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        index = self.zstd.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", SKIP_INDEX, len(index)) + index
        entries = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IB", len(entries), 0)
        return b"".join(self.frames) + index + struct.pack("<II", SKIP_SEEK_TABLE, len(table) + 4) + table


class Reader:
    """Random access to a bundle: reads the seek table, the index, and only the frames asked for."""

    def __init__(self, content: bytes):
        import zstandard

        if content[-4:] != CLOSING:
            raise ValueError("no seek table at the end of the bundle")
        n = struct.unpack_from("<I", content, len(content) - 9)[0]
        begin = len(content) - 9 - 8 * n
        self.sizes = list(struct.iter_unpack("<II", content[begin : begin + 8 * n]))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.content, self.zstd, self.last = content, zstandard.ZstdDecompressor(), (-1, b"")
        at = self.starts[n - 1]
        self.index = json.loads(self.zstd.decompress(content[at + 8 : at + self.sizes[-1][0]]))

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.last = (k, self.zstd.decompress(self.content[self.starts[k] : self.starts[k + 1]], max_output_size=self.sizes[k][1]))
        return self.last[1]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for identifier, frame, at, _ in self.index:
            headers, block, _ = parse_record(self.frame(frame)[at:][: _])
            if headers["warc-record-id"] != identifier:
                raise ValueError("the index names another record")
            yield headers, block

    def fetch(self, identifier: str) -> tuple[dict[str, str], bytes]:
        for name, frame, at, size in self.index:
            if name == identifier:
                return parse_record(self.frame(frame)[at : at + size])[:2]
        raise KeyError(identifier)


def _writer(date: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.finish()], pa.binary())], names=["content"])
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")]
            for row in zip(*columns, strict=True):
                page, url, html, digest, refers, revisit = (x.as_py() for x in row)
                payload = html.encode()
                bundle.add(record_id(page), build_record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers, revisit, date))
                if bundle.held >= bundle_bytes:
                    yield out()
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield out()

    return write


def write_bundles(pages: DataFrame, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> str:
    """Write a record for each row of ``pages`` (page_id long, url, html); returns the folder.

    A null html is an empty payload, a null url gives no target URI. Of equal payloads of at least ``min_payload`` bytes
    that with the smallest page_id (null last) is the response, rows with other page_ids revisit it; repeated rows of that
    page_id are responses too. Only digests are grouped, with partial sums before the shuffle; the payloads are shuffled
    once, by digest, where adaptive execution splits the partition of a payload that is very common.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.text_or_empty("html").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to")).withColumnRenamed("digest", "d")
    joined = rows.join(first, F.col("digest") == F.col("d"), "left").drop("d")
    revisit = (F.octet_length("html") >= min_payload) & F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    ready = joined.withColumn("revisit", revisit).select("page_id", "url", "html", "digest", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "revisit")
    return common.write_files(ready.mapInArrow(_writer(date, frame_bytes, bundle_bytes), "content binary"), CLOSING, "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            out: list[tuple] = []
            for headers, block in Reader(content.as_py()).records():
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                response = headers["warc-type"] == "response"
                if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"the payload of {headers['warc-record-id']} doesn't match its digest")
                out.append((page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], None if response else page_of(headers["warc-refers-to"]), headers.get("warc-target-uri"), path))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"])


def read_bundles(spark, path: str) -> DataFrame:
    """The records of all bundles; every response's payload is checked against its digest."""
    return common.read_files(spark, path).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")
