import base64
import hashlib

import zstandard

from pixelweave.llm import common, queries, warc

SCHEMA = "page_id long, url string, html string, digest string, revisit string"


def brute(rows, least=0):
    first = {}
    for page, html in rows:
        key = (html or "").encode()
        if page is not None:
            first[key] = min(first.get(key, page), page)
    out = []
    for page, html in rows:
        key = (html or "").encode()
        revisit = len(key) >= least and first.get(key) is not None and first[key] != page
        out.append((page, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "revisit" if revisit else "response", first[key] if revisit else None))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in queries.op3_warc(spark, sf).collect()), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\r\nX: y", "same"), (1, None, "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "alone"), (6, "u", "é" * 400_000), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for least in (0, 5):
        got = warc.read_bundles(spark, warc.write_bundles(df, least, frame_bytes=100, bundle_bytes=500))
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute([(r[0], r[2]) for r in rows], least)
    assert warc.read_bundles(spark, warc.write_bundles(df.limit(0))).count() == 0


def test_bundle_is_plain_zstd_and_seekable(spark):
    bundle = warc.Bundle(frame_bytes=300)
    for k in range(20):
        bundle.add(warc.record_id(k), warc.build_record(k, f"http://x/{k}", b"p%d" % k * 20, "D", None, False, "2020-01-01T00:00:00Z"))
    content = bundle.finish() + warc.CLOSING
    plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    at, n = 0, 0
    while at < len(plain):
        headers, block, at = warc.parse_record(plain, at)
        assert headers["warc-record-id"] == warc.record_id(n) and block.endswith(b"p%d" % n * 20)
        n += 1
    assert n == 20
    reader = warc.Reader(content)
    assert len(reader.sizes) > 3 and reader.fetch(warc.record_id(13))[1].endswith(b"p13" * 20)


def test_files_are_exact(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(b"\n"),)], "content binary")
    got = {bytes(r.content) for r in common.read_files(spark, common.write_files(df, b"\xff\x00", "t")).collect()}
    assert got == {bytes(range(256)) + b"\xff\x00", b"\n\xff\x00"}
