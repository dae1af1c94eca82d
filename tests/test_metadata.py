"""EXIF, IPTC and ICC data in files made by hand, byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from pixelweave.sources import codecs, jpeg, metadata


def jpeg_with(*segments):
    plain = jpeg.encode(np.full((8, 8, 3), 30_000))
    return plain[:2] + b"".join(bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body for kind, body in segments) + plain[2:]


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_by_hand(spark, order):
    o = order
    tiff = (b"II*\0" if o == "<" else b"MM\0*") + struct.pack(o + "I", 8)
    # main: Make (text outside), Orientation (inside), pointers; EXIF: ExposureTime; GPS: latitude of three rationals
    tiff += struct.pack(o + "H", 4) + struct.pack(o + "HHII", 0x010F, 2, 6, 62) + struct.pack(o + "HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(o + "HHII", 0x8769, 4, 1, 68) + struct.pack(o + "HHII", 0x8825, 4, 1, 94) + struct.pack(o + "I", 0)
    tiff += b"Canon\0" + struct.pack(o + "H", 1) + struct.pack(o + "HHII", 0x829A, 5, 1, 86) + struct.pack(o + "I", 0) + struct.pack(o + "II", 1, 250)
    tiff += struct.pack(o + "H", 1) + struct.pack(o + "HHII", 2, 5, 3, 112) + struct.pack(o + "I", 0) + struct.pack(o + "6I", 52, 1, 31, 1, 12, 5)
    png_head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 0) + b"IHDR" + bytes(4) + struct.pack(">I", len(tiff)) + b"eXIf" + tiff + bytes(4)
    files = [jpeg_with((0xE1, b"http://ns.adobe.com/xap/1.0/\0x"), (0xE1, b"Exif\0\0" + tiff)), png_head, tiff, b"", b"nothing", tiff[:40]]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(files)], "image_id long, content binary")
    got = metadata.exif_tags(df).collect()
    for k in range(3):
        assert sorted((r.ifd, r.name, r.text) for r in got if r.image_id == k) == [("exif", "ExposureTime", "1/250"), ("gps", "GpsLatitude", "52/1, 31/1, 12/5"), ("ifd0", "Make", "Canon"), ("ifd0", "Orientation", "6")]
    assert not [r for r in got if r.image_id in (3, 4)]
    found = metadata.first_tag(metadata.exif_tags(df), 0x829A).collect()
    assert {(r.image_id, r.ifd, r.text) for r in found} == {(k, "exif", "1/250") for k in range(3)}


def test_profile_edits_and_all_types():
    for order in "<>":
        exif = metadata.Exif(order)
        values = [("ifd0", 0x0100, 4, "640"), ("ifd0", 0x0102, 3, "8, 8, 8"), ("ifd0", 0x010E, 2, "a long description"), ("exif", 0x9204, 10, "-1/3"), ("exif", 0x9000, 7, "0x30 0x32 0x33 0x32"), ("gps", 5, 1, "1"), ("exif", 0xA500, 12, "2.5")]
        for ifd, tag, kind, text in values:
            exif.set(metadata.Entry.of(tag, kind, text, order), ifd)
        again = metadata.parse_tiff(metadata.build_tiff(exif))
        assert [(k, e.tag, e.kind, e.text(order)) for k, e in again.all()] == sorted(values, key=lambda v: (metadata.ORDER.index(v[0]), v[1]))
        assert again.get(0x9204).pairs(order) == [(-1, 3)] and again.get(1) is None
        assert again.remove(0x0100) and not again.remove(0x0100) and again.get(0x0100) is None
    assert metadata.tag_name(0x0112) == "Orientation" and metadata.tag_name(2, "gps") == "GpsLatitude" and metadata.tag_name(0xBEEF) == "0xBEEF"


def test_iptc_icc_and_strip(spark):
    iptc = b"\x1c\x01\x5a\x00\x03\x1b%G" + b"\x1c\x02\x05\x00\x05Title" + b"\x1c\x02\x19\x00\x03one" + b"\x1c\x02\x19\x00\x03two"
    resource = b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">H", 0x03ED) + b"\x03abc" + struct.pack(">I", 3) + b"xyz\0" + b"8BIM" + struct.pack(">HH", 0x0404, 0) + struct.pack(">I", len(iptc)) + iptc
    profile = bytes(range(256)) * 3
    icc = [(0xE2, b"ICC_PROFILE\0" + bytes([k + 1, 2]) + part) for k, part in enumerate((profile[:500], profile[500:]))]
    full = jpeg_with((0xED, resource), *icc[::-1], (0xFE, b"comment"))
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 0) + b"IHDR" + bytes(4)
    body = b"name\0\0" + zlib.compress(profile)
    png += struct.pack(">I", len(body)) + b"iCCP" + body + bytes(4)
    df = spark.createDataFrame([(0, bytearray(full)), (1, bytearray(png)), (2, bytearray(jpeg_with()))], "image_id long, content binary")
    records = metadata.iptc_records(df)
    assert [(r.image_id, r.name, r.text) for r in records.orderBy("place").collect()] == [(0, "ObjectName", "Title"), (0, "Keywords", "one"), (0, "Keywords", "two")]
    assert [r.text for r in metadata.first_value(records, 25).collect()] == ["one"]
    assert {r.image_id: bytes(r.profile) for r in metadata.icc_profiles(df).collect()} == {0: profile, 1: profile}
    bare = bytes(metadata.stripped(df.where("image_id = 0")).first().content)
    assert bare == jpeg_with() and (jpeg.decode(bare) == jpeg.decode(full)).all()
    rows = spark.createDataFrame([(0, 1, 120, "später"), (0, 0, 80, "me")], "image_id long, place int, data_set int, text string")
    again = metadata.with_iptc(df.where("image_id = 0"), rows)
    assert [(r.name, r.text) for r in metadata.iptc_records(again).orderBy("place").collect()] == [("Byline", "me"), ("Caption", "später")]
    assert metadata.icc_profiles(again).count() == 1


def test_exif_is_replaced_in_files(spark):
    tags = spark.createDataFrame([(k, "ifd0", 0x0112, 3, str(k + 1)) for k in range(2)], "image_id long, ifd string, tag int, type int, text string")
    png = codecs.codec("png")[1](np.full((4, 4, 3), 500))
    df = spark.createDataFrame([(0, bytearray(jpeg_with())), (1, bytearray(png))], "image_id long, content binary")
    twice = metadata.with_exif(metadata.with_exif(df, tags), tags, big_endian=True)
    assert sorted((r.image_id, r.text) for r in metadata.exif_tags(twice).collect()) == [(0, "1"), (1, "2")]
    assert (codecs.codec("png")[0](bytes(twice.where("image_id = 1").first().content)) == 500).all()
