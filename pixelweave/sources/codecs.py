"""Image files as rows: format probes, decoders and encoders, and their Spark source and sink.

Decoders give an (h, w, c) array of 16-bit values with c = 3 or 4; encoders take one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import follow

#: Leading bytes (offset, hexadecimal) of formats, in order of probing.
SIGNATURES = [
    ("png", 0, "89504E470D0A1A0A"),
    ("jpeg", 0, "FFD8"),
    ("gif", 0, "474946383761"),
    ("gif", 0, "474946383961"),
    ("webp", 8, "57454250"),
    ("tiff", 0, "49492A00"),
    ("tiff", 0, "4D4D002A"),
    ("bmp", 0, "424D"),
    ("psd", 0, "38425053"),
    ("dds", 0, "44445320"),
    ("qoi", 0, "716F6966"),
    ("hdr", 0, "233F52414449414E4345"),
    ("hdr", 0, "233F52474245"),
    ("ico", 0, "00000100"),
    ("farbfeld", 0, "66617262666C6421"),
    ("farbfeld", 0, "6661726266656C64"),
    ("dpx", 0, "53445058"),
    ("dpx", 0, "58504453"),
    ("fits", 0, "53494D504C4520"),
    ("cin", 0, "802A5FD7"),
    ("dicom", 128, "4449434D"),
    ("jpeg2000", 0, "0000000C6A5020200D0A870A"),
    ("jpeg2000", 0, "FF4FFF51"),
    ("jxl", 0, "FF0A"),
    ("jxl", 0, "0000000C4A584C20"),
    ("avif", 4, "66747970"),
    ("exr", 0, "762F3101"),
    ("sgi", 0, "01DA"),
    ("sun", 0, "59A66A95"),
    *[("pcx", 0, f"0A{v:02X}01") for v in (0, 2, 3, 4, 5)],
    ("xpm", 0, "2F2A2058504D"),
    ("tensor", 0, "54454E53"),
    *[("pnm", 0, f"50{0x30 + k:02X}") for k in range(1, 7)],
]
#: Extensions of formats whose content has no signature.
EXTENSIONS = {"tga": "tga", "wbmp": "wbmp", "pix": "pix", "xbm": "xbm", "xpm": "xpm", "svg": "svg", "pdf": "pdf", "raw": "raw", "jpg": "jpeg", "tif": "tiff", "ff": "farbfeld", "ppm": "pnm", "pgm": "pnm", "pbm": "pnm", "tensor": "tensor"}


def detect(content: Column) -> Column:
    """The format's name by leading bytes, or null: one ordered expression, no Python."""
    out = None
    for name, at, digits in SIGNATURES:
        hit = F.hex(F.substring(content, at + 1, len(digits) // 2)) == digits
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(F.octet_length(content) >= 4, out)


def detect_extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = F.when(ext == "", None)
    for e, name in EXTENSIONS.items():
        out = out.when(ext == e, name)
    return out.otherwise(ext)


def _bytes(p: np.ndarray) -> np.ndarray:
    v = p.astype(np.int64) + 128
    return (v - (v >> 8) >> 8).astype(np.uint8)


def _with_alpha(p: np.ndarray) -> np.ndarray:
    return p if p.shape[2] == 4 else np.concatenate([p, np.full((*p.shape[:2], 1), 65535, p.dtype)], axis=2)


def farbfeld_encode(p: np.ndarray) -> bytes:
    return b"farbfeld" + struct.pack(">II", p.shape[1], p.shape[0]) + _with_alpha(p).astype(">u2").tobytes()


def farbfeld_decode(data: bytes) -> np.ndarray:
    w, h = struct.unpack_from(">II", data, 8)
    return np.frombuffer(data, ">u2", w * h * 4, 16).reshape(h, w, 4).astype(np.int32)


def pnm_encode(p: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + _bytes(p[:, :, :3]).tobytes()


def pnm_decode(data: bytes) -> np.ndarray:
    kind, at, numbers = int(data[1:2]), 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    w, h, top = (*numbers, 1)[:3]
    n = 3 if kind in (3, 6) else 1
    if kind <= 3:
        body = data[at:].split() if kind != 1 else [bytes([b]) for b in data[at:] if b in b"01"]
        v = np.array([int(x) for x in body[: w * h * n]], np.int64)
    elif kind == 4:
        v = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w].astype(np.int64)
    else:
        v = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * n, at + 1).astype(np.int64)
    v = (1 - v) if kind in (1, 4) else v
    return np.broadcast_to((v * 65535 * 2 + top) // (2 * top) if top != 255 else v * 257, v.shape).reshape(h, w, n).astype(np.int32).repeat(3 // n, axis=2)


def bmp_encode(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = _bytes(p[::-1, :, 2::-1]).reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def bmp_decode(data: bytes) -> np.ndarray:
    """Uncompressed 8, 24 and 32 bits."""
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP isn't read")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        table = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        return table[rows].astype(np.int32) * 257
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].astype(np.int32) * 257


def tga_encode(p: np.ndarray) -> bytes:
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, p.shape[1], p.shape[0], 24, 0x20) + _bytes(p[:, :, 2::-1]).tobytes()


def tga_decode(data: bytes) -> np.ndarray:
    n_id, _, kind, _, _, _, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    n, at = bits // 8, 18 + n_id
    if kind in (2, 3):
        v = np.frombuffer(data, np.uint8, w * h * n, at)
    elif kind in (10, 11):
        out, size = bytearray(), w * h * n
        while len(out) < size:
            count, at = (data[at] & 127) + 1, at + 1
            if data[at - 1] & 128:
                out += data[at : at + n] * count
                at += n
            else:
                out += data[at : at + n * count]
                at += n * count
        v = np.frombuffer(bytes(out), np.uint8)
    else:
        raise ValueError("this kind of TGA isn't read")
    v = v.reshape(h, w, n)
    v = v if flags & 0x20 else v[::-1]
    v = v.repeat(3, axis=2) if n == 1 else v[:, :, [2, 1, 0, 3][:n]]
    return v.astype(np.int32) * 257


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(p: np.ndarray) -> bytes:
    """16 bits a channel, each row with the better of no filter and the difference to the row above."""
    h, w, n = p.shape
    raw = p.astype(">u2").view(np.uint8).reshape(h, -1)
    up = raw.copy()
    up[1:] -= raw[:-1]
    cost = lambda r: np.minimum(r, 256 - r.astype(np.int32)).sum(axis=1)
    better = cost(up) < cost(raw)
    rows = np.concatenate([np.where(better, 2, 0).astype(np.uint8)[:, None], np.where(better[:, None], up, raw)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 2 if n == 3 else 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(data: np.ndarray, h: int, stride: int, unit: int) -> np.ndarray:
    out = np.zeros((h + 1, stride + unit), np.int32)
    rows = data[: h * (stride + 1)].reshape(h, stride + 1)
    for y in range(h):
        kind, line, above, here = rows[y, 0], rows[y, 1:].astype(np.int32), out[y], out[y + 1]
        if kind == 0:
            here[unit:] = line
        elif kind == 2:
            here[unit:] = (line + above[unit:]) & 255
        elif kind == 1:
            for k in range(unit):
                here[unit + k :: unit] = np.cumsum(line[k::unit]) & 255
        else:
            for x in range(stride):
                a, b, c = int(here[x]), int(above[x + unit]), int(above[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    q = a + b - c
                    guess = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
                here[x + unit] = (line[x] + guess) & 255
    return out[1:, unit:].astype(np.uint8)


def png_decode(data: bytes) -> np.ndarray:
    """All colour types and depths, five filters, interlaced or not, transparent colours."""
    at, body, palette, clear = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw, used = np.frombuffer(zlib.decompress(body), np.uint8), 0
    v = np.zeros((h, w, n), np.int32)
    grids = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if lace else [(0, 0, 1, 1)]
    for x0, y0, dx, dy in grids:
        pw, ph = -(-(w - x0) // dx) if w > x0 else 0, -(-(h - y0) // dy) if h > y0 else 0
        if not pw or not ph:
            continue
        stride = (pw * n * depth + 7) // 8
        rows = _unfilter(raw[used:], ph, stride, max(1, n * depth // 8))
        used += ph * (stride + 1)
        if depth == 16:
            line = rows.reshape(ph, pw * n, 2).astype(np.int32) @ np.array([256, 1])
        elif depth == 8:
            line = rows.astype(np.int32)
        else:
            line = np.unpackbits(rows, axis=1).reshape(ph, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        v[y0::dy, x0::dx] = line[:, : pw * n].reshape(ph, pw, n)
    if color == 3:
        out = palette[v[:, :, 0]].astype(np.int32) * 257
        if clear is not None:
            alpha = np.full(256, 255, np.int32)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out = np.concatenate([out, alpha[v[:, :, 0]][:, :, None] * 257], axis=2)
        return out
    top = (1 << depth) - 1
    seen = None
    if clear is not None and color in (0, 2):
        seen = ~(v == np.frombuffer(clear, ">u2").astype(np.int32)).all(axis=2)
    out = v if depth == 16 else v * 65535 // top
    out = np.concatenate([out[:, :, :1].repeat(3, axis=2), *([out[:, :, 1:]] if n == 2 else [])], axis=2) if n <= 2 else out
    return out if seen is None else np.concatenate([out, np.where(seen, 65535, 0)[:, :, None]], axis=2)


def qoi_encode(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    n = p.shape[2]
    out = bytearray(b"qoif" + struct.pack(">IIBB", w, h, n, 0))
    pixels = _bytes(_with_alpha(p)).reshape(-1, 4).tolist()
    index, before, run = [[0, 0, 0, 0] for _ in range(64)], [0, 0, 0, 255], 0
    for k, px in enumerate(pixels):
        if px == before:
            run += 1
            if run == 62 or k == len(pixels) - 1:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        r, g, b, a = px
        at = (r * 3 + g * 5 + b * 7 + a * 11) % 64
        dr, dg, db = ((x - y + 128) % 256 - 128 for x, y in zip(px[:3], before[:3], strict=True))
        if index[at] == px:
            out.append(at)
        elif a == before[3] and -2 <= dr <= 1 and -2 <= dg <= 1 and -2 <= db <= 1:
            out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
        elif a == before[3] and -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
            out += bytes([0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8])
        elif a == before[3]:
            out += bytes([0xFE, r, g, b])
        else:
            out += bytes([0xFF, r, g, b, a])
        index[at], before = px, px
    return bytes(out + b"\0" * 7 + b"\1")


def qoi_decode(data: bytes) -> np.ndarray:
    w, h, n, _ = struct.unpack_from(">IIBB", data, 4)
    index, px, at, out = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, []
    while len(out) < w * h:
        tag, run = data[at], 1
        at += 1
        r, g, b, a = px
        if tag == 0xFE:
            px, at = (*data[at : at + 3], a), at + 3
        elif tag == 0xFF:
            px, at = tuple(data[at : at + 4]), at + 4
        elif tag >> 6 == 0:
            px = index[tag]
        elif tag >> 6 == 1:
            px = ((r + (tag >> 4 & 3) - 2) % 256, (g + (tag >> 2 & 3) - 2) % 256, (b + (tag & 3) - 2) % 256, a)
        elif tag >> 6 == 2:
            dg = (tag & 63) - 32
            px, at = ((r + dg + (data[at] >> 4) - 8) % 256, (g + dg) % 256, (b + dg + (data[at] & 15) - 8) % 256, a), at + 1
        else:
            run = (tag & 63) + 1
        index[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out += [px] * run
    return np.array(out[: w * h], np.int32).reshape(h, w, 4)[:, :, :n] * 257


CODECS: dict[str, tuple[Callable[[bytes], np.ndarray], Callable[[np.ndarray], bytes]]] = {
    "farbfeld": (farbfeld_decode, farbfeld_encode),
    "pnm": (pnm_decode, pnm_encode),
    "bmp": (bmp_decode, bmp_encode),
    "tga": (tga_decode, tga_encode),
    "png": (png_decode, png_encode),
    "qoi": (qoi_decode, qoi_encode),
}
IMAGE = "image_id long, path string, format string, width int, height int, channels int, data binary, error string"


def codec(kind: str) -> tuple[Callable[[bytes], np.ndarray], Callable[[np.ndarray], bytes]]:
    """Decoder and encoder of a format, or a ValueError."""
    from . import jpeg, more_codecs, webp

    try:
        return (CODECS | more_codecs.CODECS | {"jpeg": (jpeg.decode, jpeg.encode), "webp": (webp.decode, webp.encode)})[kind]
    except KeyError:
        raise ValueError(f"no codec for {kind}") from None


#: Bytes of values from which on ``decode`` gives its images away, as one Arrow batch.
DECODED_BYTES = 1 << 20


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``decode`` in a task, of batches with the format: no more than DECODED_BYTES and one image are held decoded."""
    names = ["image_id", "path", "format", "width", "height", "channels", "data", "error"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def together(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        out, held = [], 0
        for image_id, path, kind, content in zip(*(batch.column(c) for c in ("image_id", "path", "format", "content")), strict=True):
            row = [image_id.as_py(), path.as_py(), kind.as_py(), None, None, None, None, None]
            try:
                p = codec(row[2])[0](content.as_py())
                row[3:7] = p.shape[1], p.shape[0], p.shape[2], p.astype("<u2").tobytes()
            except Exception as e:  # noqa: BLE001  a broken file is a row with its error
                row[7] = f"{type(e).__name__}: {e}"
            out.append(row)
            held += len(row[6] or b"")
            if held >= DECODED_BYTES:
                yield together(out)
                out, held = [], 0
        if out:
            yield together(out)


def decode(files: DataFrame) -> DataFrame:
    """image_id, path, format, width, height, channels, data (16-bit little-endian, h x w x c), error of (image_id, path, content).

    A file that can't be read gives a row with its error. The format comes from the content, else from the extension.
    """
    rows = files.select("image_id", "path", F.coalesce(detect(F.col("content")), detect_extension(F.col("path"))).alias("format"), "content")
    return follow(rows, ["image_id", "path", "format", "content"], decoded, IMAGE)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder; image_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path)
    return decode(files.select(F.xxhash64("path").alias("image_id"), "path", "content"))


#: Pixels in one Arrow batch that ``to_pixels`` gives.
BATCH_PIXELS = 1 << 16


def to_pixels(images: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """pixels_wide of decoded images, two bytes a value: numpy views of the data, batches of BATCH_PIXELS rows.

    Columns to ``keep`` follow, an image's value at each of its pixels.
    """
    names = ["image_id", "y", "x", "r", "g", "b", "a", *keep]
    error = [c for c in images.columns if c == "error"]

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("error").is_null()) if error else batch
            for image_id, width, channels, data, *kept in zip(*(batch.column(c) for c in ("image_id", "width", "channels", "data", *keep)), strict=True):
                w, c = width.as_py(), channels.as_py()
                values = np.frombuffer(data.as_buffer(), "<u2").reshape(-1, c)
                for at in range(0, len(values), BATCH_PIXELS):
                    part = values[at : at + BATCH_PIXELS].astype(np.int32)
                    place = np.arange(at, at + len(part))
                    planes = [pa.array(part[:, k]) for k in range(min(c, 4))] + [pa.nulls(len(part), pa.int32())] * (4 - min(c, 4))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), image_id.as_py(), np.int64)), pa.array((place // w).astype(np.int32)), pa.array((place % w).astype(np.int32)), *planes, *[pa.repeat(v, len(part)) for v in kept]], names=names)

    return follow(images, ["image_id", "width", "channels", "data", *keep, *error], run, ", ".join(["image_id long, y int, x int, r int, g int, b int, a int", *[f"{c} {images.schema[c].dataType.simpleString()}" for c in keep]]))


def encode(pixels: DataFrame, kind: str, **options) -> DataFrame:
    """image_id, content of pixels_wide: one group an image. ``options`` go to the encoder (JPEG: quality, sampling, progressive)."""
    import pandas as pd

    put = codec(kind)[1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["r", "g", "b"] + (["a"] if pdf.a.notna().all() else [])
        p = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, len(names)), np.int32)
        p[pdf.y, pdf.x] = pdf[names].astype(int)
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "content": [put(p, **options)]})

    return pixels.select("image_id", "y", "x", "r", "g", "b", "a").groupBy("image_id").applyInPandas(run, "image_id long, content binary")
