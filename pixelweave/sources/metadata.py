"""EXIF, IPTC and ICC data of image files as tables, and tables written back as their binary forms.

A tag's text is its display form: text as it is, numbers and rationals (1/3) parted by ", ", up to eight undefined bytes as
0x01 0x02, else their number; the value's own bytes stand beside it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of EXIF tags, of GPS tags, and of IPTC data sets of record 2.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0115: "SamplesPerPixel",
    0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x8769: "ExifIfdPointer", 0x8825: "GpsIfdPointer", 0x829A: "ExposureTime", 0x829D: "FNumber",
    0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue",
    0x9205: "MaxApertureValue", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9286: "UserComment", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA405: "FocalLengthIn35mmFilm",
    0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {0: "GpsVersionId", 1: "GpsLatitudeRef", 2: "GpsLatitude", 3: "GpsLongitudeRef", 4: "GpsLongitude", 5: "GpsAltitudeRef", 6: "GpsAltitude", 7: "GpsTimestamp", 0x1D: "GpsDateStamp"}
DATA_SETS = {
    5: "ObjectName", 10: "Urgency", 15: "Category", 25: "Keywords", 40: "SpecialInstructions", 55: "DateCreated", 60: "TimeCreated", 80: "Byline", 85: "BylineTitle", 90: "City", 92: "SubLocation", 95: "ProvinceState", 100: "CountryCode",
    101: "CountryName", 105: "Headline", 110: "Credit", 115: "Source", 116: "CopyrightNotice", 120: "Caption", 122: "CaptionWriter",
}
#: Bytes of a value, and its letter, of each TIFF type.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
POINTERS = {0x8769: "exif", 0x8825: "gps"}
ORDER = ("ifd0", "exif", "gps")


def tag_name(tag: int, ifd: str = "ifd0") -> str:
    return (GPS_TAGS if ifd == "gps" else TAGS).get(tag) or f"0x{tag:04X}"


def data_set_name(number: int) -> str:
    return DATA_SETS.get(number) or f"DataSet{number}"


@dataclass
class Entry:
    tag: int
    kind: int
    count: int
    value: bytes  #: in the profile's byte order

    def numbers(self, order: str = "<") -> list:
        size, letter = TYPES[self.kind]
        return list(struct.unpack_from(f"{order}{self.count * len(letter)}{letter[0]}", self.value))

    def pairs(self, order: str = "<") -> list[tuple[int, int]]:
        flat = self.numbers(order)
        return list(zip(flat[::2], flat[1::2], strict=True))

    def text(self, order: str = "<") -> str:
        if self.kind == 2:
            return self.value.split(b"\0")[0].decode("utf-8", "replace")
        if self.kind == 7:
            return " ".join(f"0x{b:02X}" for b in self.value) if self.count <= 8 else f"({self.count} bytes)"
        if self.kind in (5, 10):
            return ", ".join(f"{a}/{b}" for a, b in self.pairs(order))
        return ", ".join(str(v) for v in self.numbers(order))

    @classmethod
    def of(cls, tag: int, kind: int, text: str, order: str = "<") -> Entry:
        """The entry of a display text."""
        if kind == 2:
            value = text.encode() + b"\0"
            return cls(tag, kind, len(value), value)
        if kind == 7:
            value = bytes(int(x, 16) for x in text.split())
            return cls(tag, kind, len(value), value)
        parts = [x for x in text.split(", ") if x]
        read = float if kind in (11, 12) else int
        flat = [read(v) for x in parts for v in x.split("/")]
        return cls(tag, kind, len(parts), struct.pack(f"{order}{len(flat)}{TYPES[kind][1][0]}", *flat))


@dataclass
class Exif:
    """Entries of the main, EXIF and GPS directories by tag, in one byte order."""

    order: str = "<"
    ifds: dict[str, dict[int, Entry]] = field(default_factory=lambda: {k: {} for k in ORDER})

    def get(self, tag: int) -> Entry | None:
        return next((self.ifds[k][tag] for k in ORDER if tag in self.ifds[k]), None)

    def set(self, entry: Entry, ifd: str = "ifd0") -> None:
        self.ifds[ifd][entry.tag] = entry

    def remove(self, tag: int) -> bool:
        return any([self.ifds[k].pop(tag, None) is not None for k in ORDER])

    def all(self) -> Iterator[tuple[str, Entry]]:
        for k in ORDER:
            for _, entry in sorted(self.ifds[k].items()):
                yield k, entry


def parse_tiff(data: bytes) -> Exif | None:
    """EXIF data of a TIFF structure; entries that point outside it are left out."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return None
    out = Exif("<" if data[:1] == b"I" else ">")
    seen: set[int] = set()

    def read(at: int, name: str) -> None:
        if at in seen or at < 8 or at + 2 > len(data):
            return
        seen.add(at)
        for k in range(struct.unpack_from(f"{out.order}H", data, at)[0]):
            place = at + 2 + 12 * k
            if place + 12 > len(data):
                return
            tag, kind, count = struct.unpack_from(f"{out.order}HHI", data, place)
            if kind not in TYPES:
                continue
            size = TYPES[kind][0] * count
            begin = place + 8 if size <= 4 else struct.unpack_from(f"{out.order}I", data, place + 8)[0]
            if begin + size > len(data):
                continue
            if tag in POINTERS and name == "ifd0" and kind == 4 and count == 1:
                read(struct.unpack_from(f"{out.order}I", data, begin)[0], POINTERS[tag])
            else:
                out.ifds[name][tag] = Entry(tag, kind, count, bytes(data[begin : begin + size]))

    read(struct.unpack_from(f"{out.order}I", data, 4)[0] if len(data) >= 8 else 0, "ifd0")
    return out


def build_tiff(exif: Exif) -> bytes:
    o = exif.order
    out = bytearray((b"II*\0" if o == "<" else b"MM\0*") + struct.pack(f"{o}I", 8))
    used = [k for k in ORDER if exif.ifds[k] or k == "ifd0"]
    back: dict[str, int] = {}
    for name in used:
        entries = [e for t, e in sorted(exif.ifds[name].items())]
        if name == "ifd0":
            entries = sorted([e for e in entries if e.tag not in POINTERS] + [Entry(t, 4, 1, bytes(4)) for t, k in POINTERS.items() if k in used], key=lambda e: e.tag)
        else:
            struct.pack_into(f"{o}I", out, back[name], len(out))
        begin = len(out)
        out += struct.pack(f"{o}H", len(entries)) + bytes(12 * len(entries) + 4)
        for k, e in enumerate(entries):
            place = begin + 2 + 12 * k
            struct.pack_into(f"{o}HHI", out, place, e.tag, e.kind, e.count)
            if name == "ifd0" and e.tag in POINTERS:
                back[POINTERS[e.tag]] = place + 8
            elif len(e.value) <= 4:
                out[place + 8 : place + 8 + len(e.value)] = e.value
            else:
                struct.pack_into(f"{o}I", out, place + 8, len(out))
                out += e.value + bytes(len(e.value) % 2)
    return bytes(out)


# --- files --------------------------------------------------------------------------------------------------------------------------


def _jpeg_segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, place, payload) of the segments before the image data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind in (0xDA, 0xD9) or size < 2:
            return
        yield kind, at, data[at + 4 : at + 2 + size]
        at += 2 + size


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], at, data[at + 8 : at + 8 + size]
        at += 12 + size


def exif_of(data: bytes) -> Exif | None:
    """From a JPEG file's APP1, a PNG file's eXIf chunk, or a bare TIFF structure."""
    if data[:2] == b"\xff\xd8":
        return next((found for kind, _, body in _jpeg_segments(data) if kind == 0xE1 and body[:6] == b"Exif\0\0" and (found := parse_tiff(body[6:]))), None)
    if data[:4] == b"\x89PNG":
        return next((parse_tiff(body) for kind, _, body in _png_chunks(data) if kind == b"eXIf"), None)
    return parse_tiff(data)


def put_exif(data: bytes, exif: Exif) -> bytes:
    """The JPEG or PNG file with this EXIF data instead of its own."""
    body = build_tiff(exif)
    if data[:2] == b"\xff\xd8":
        if len(body) > 65_527:
            raise ValueError("EXIF data of a JPEG file must stay below 64 KiB")
        rest = strip(data, keep=lambda kind, body: not (kind == 0xE1 and body[:6] == b"Exif\0\0"))
        return rest[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + rest[2:]
    if data[:4] == b"\x89PNG":
        parts = [data[at : at + 12 + len(chunk)] for kind, at, chunk in _png_chunks(data) if kind != b"eXIf"]
        new = struct.pack(">I", len(body)) + b"eXIf" + body + struct.pack(">I", zlib.crc32(b"eXIf" + body))
        return data[:8] + parts[0] + new + b"".join(parts[1:])
    raise ValueError("only JPEG and PNG files take EXIF data")


def strip(data: bytes, keep: Callable[[int, bytes], bool] = lambda kind, body: not 0xE1 <= kind <= 0xEF and kind != 0xFE) -> bytes:
    """A JPEG file without the segments that ``keep`` refuses: all application data but JFIF, and comments."""
    out, end = [data[:2]], 2
    for kind, at, body in _jpeg_segments(data):
        end = at + 4 + len(body)
        if keep(kind, body):
            out.append(data[at:end])
    return b"".join([*out, data[end:]])


def parse_iptc(data: bytes) -> list[tuple[int, bytes]]:
    """(data set, value) of the records of number 2."""
    out, at = [], 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, number, size = data[at + 1], data[at + 2], struct.unpack_from(">H", data, at + 3)[0]
        if size & 0x8000 or at + 5 + size > len(data):
            break
        if record == 2:
            out.append((number, data[at + 5 : at + 5 + size]))
        at += 5 + size
    return out


def build_iptc(records: list[tuple[int, bytes]]) -> bytes:
    return b"".join(b"\x1c\x02" + struct.pack(">BH", number, len(value)) + value for number, value in records)


def iptc_of(data: bytes) -> list[tuple[int, bytes]]:
    """From the 8BIM resource 0x0404 of a JPEG file's APP13."""
    for kind, _, body in _jpeg_segments(data) if data[:2] == b"\xff\xd8" else ():
        if kind == 0xED and body.startswith(b"Photoshop 3.0\0"):
            at = 14
            while at + 12 <= len(body) and body[at : at + 4] == b"8BIM":
                number, name = struct.unpack_from(">HB", body, at + 4)
                begin = at + 6 + (name + 2) // 2 * 2
                size = struct.unpack_from(">I", body, begin)[0]
                if number == 0x0404:
                    return parse_iptc(body[begin + 4 : begin + 4 + size])
                at = begin + 4 + size + size % 2
    return []


def put_iptc(data: bytes, records: list[tuple[int, bytes]]) -> bytes:
    """The JPEG file with these records instead of its APP13."""
    body = build_iptc(records)
    resource = b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">HH", 0x0404, 0) + struct.pack(">I", len(body)) + body + bytes(len(body) % 2)
    if len(resource) > 65_533:
        raise ValueError("IPTC data of a JPEG file must stay below 64 KiB")
    rest = strip(data, keep=lambda kind, _: kind != 0xED)
    return rest[:2] + b"\xff\xed" + struct.pack(">H", len(resource) + 2) + resource + rest[2:]


def icc_of(data: bytes) -> bytes | None:
    """The ICC profile of a JPEG file (APP2, in numbered parts) or of a PNG file (iCCP)."""
    if data[:2] == b"\xff\xd8":
        parts = sorted((body[12], body[14:]) for kind, _, body in _jpeg_segments(data) if kind == 0xE2 and body.startswith(b"ICC_PROFILE\0") and len(body) > 14)
        return b"".join(p for _, p in parts) or None
    if data[:4] == b"\x89PNG":
        return next((zlib.decompress(body[body.index(b"\0") + 2 :]) for kind, _, body in _png_chunks(data) if kind == b"iCCP" and b"\0" in body), None)
    return None


# --- tables -------------------------------------------------------------------------------------------------------------------------


def _rows(files: DataFrame, schema: str, of: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """image_id and the rows that ``of`` finds in each file's content; a file that can't be read gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for image_id, content in zip(batch.column("image_id").to_pylist(), batch.column("content"), strict=True):
                try:
                    found += [(image_id, *row) for row in of(content.as_py() or b"")]
                except (ValueError, struct.error, zlib.error, IndexError):
                    continue
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    wide = f"image_id long, {schema}"
    kinds_by_name = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*[(p.split()[0], kinds_by_name[p.split()[1]]) for p in re.split(r",\s*", wide)], strict=True)
    names, kinds = list(names), list(kinds)
    return files.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(run, wide)


def exif_tags(files: DataFrame) -> DataFrame:
    """image_id, ifd, tag, name, type, count, text, value of every EXIF entry of files (image_id, content)."""

    def of(data: bytes):
        exif = exif_of(data)
        return [(k, e.tag, tag_name(e.tag, k), e.kind, e.count, e.text(exif.order), e.value) for k, e in exif.all()] if exif else []

    return _rows(files, "ifd string, tag int, name string, type int, count long, text string, value binary", of)


def iptc_records(files: DataFrame) -> DataFrame:
    """image_id, place, data_set, name, text of every IPTC record, in their order."""
    return _rows(files, "place int, data_set int, name string, text string", lambda data: [(k, n, data_set_name(n), v.decode("utf-8", "replace")) for k, (n, v) in enumerate(iptc_of(data))])


def icc_profiles(files: DataFrame) -> DataFrame:
    """image_id, size, profile of files that hold an ICC profile."""
    return _rows(files, "size long, profile binary", lambda data: [(len(p), p) for p in [icc_of(data)] if p])


def _edit(files: DataFrame, columns: list[str], change: Callable[[bytes, list], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("image_id", "content", *columns)], strict=True)
            done = [(image_id, change(content, rest)) for image_id, content, *rest in rows]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], names=["image_id", "content"])

    return files.select(F.col("image_id").cast("long").alias("image_id"), "content", *columns).mapInArrow(run, "image_id long, content binary")


def with_exif(files: DataFrame, tags: DataFrame, big_endian: bool = False) -> DataFrame:
    """Files with the EXIF entries of a table (image_id, ifd, tag, type, text), which are few for an image; other data stay."""
    entries = tags.groupBy("image_id").agg(F.collect_list(F.struct("ifd", "tag", "type", "text")).alias("md_tags"))

    def change(content: bytes, rest: list) -> bytes:
        exif = Exif(">" if big_endian else "<")
        for row in rest[0] or []:
            exif.set(Entry.of(row["tag"], row["type"], row["text"], exif.order), row["ifd"])
        return put_exif(content, exif)

    return _edit(files.join(entries, "image_id"), ["md_tags"], change)


def with_iptc(files: DataFrame, records: DataFrame) -> DataFrame:
    """JPEG files with the IPTC records of a table (image_id, place, data_set, text)."""
    entries = records.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", "data_set", "text"))).alias("md_records"))
    return _edit(files.join(entries, "image_id"), ["md_records"], lambda content, rest: put_iptc(content, [(r["data_set"], r["text"].encode()) for r in rest[0]]))


def stripped(files: DataFrame) -> DataFrame:
    """JPEG files without application data and comments."""
    return _edit(files, [], lambda content, rest: strip(content))


def first_value(records: DataFrame, data_set: int) -> DataFrame:
    """image_id, text of the first record of a data set."""
    return records.where(F.col("data_set") == data_set).groupBy("image_id").agg(F.min_by("text", "place").alias("text"))


def first_tag(tags: DataFrame, tag: int) -> DataFrame:
    """image_id, ifd, text of a tag, from the first directory that has it."""
    place = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("ifd"))
    return tags.where(F.col("tag") == tag).groupBy("image_id").agg(F.min_by(F.struct("ifd", "text"), place).alias("t")).select("image_id", "t.ifd", "t.text")


def name_of(tag: Column) -> Column:
    """A main or EXIF tag's name by a literal map."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (k, v)])[tag], F.format_string("0x%04X", tag))
