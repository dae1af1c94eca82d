"""TIFF files page by page and part by part: strips and tiles, classic and Big, from any file that can seek.

A page is its directory until its pixels are asked for, and a part (a strip or a tile) can be read without the others, so
a reader of many large pages holds one part at a time.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from . import ccitt
from .more_codecs import _packbits

#: Fixed values of the format: bytes and struct codes of the kinds of numbers that are read.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 13: "I", 16: "Q"}
PLAIN, HUFFMAN, GROUP3, GROUP4, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 2, 3, 4, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, PACKING, PHOTOMETRIC, FILL, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, FAX3, PREDICTOR, COLORS, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, EXTRA = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284, 292, 317, 320, 322, 323, 324, 325, 338


def lzw_decode(data: bytes) -> bytes:
    """Variable-width codes, greatest bits first; the width grows one code early."""
    bits = int.from_bytes(data, "big")
    total, at, width = len(data) * 8, 0, 9
    table: list[bytes] = []
    out, before = [], b""
    while at + width <= total:
        code = bits >> total - at - width & (1 << width) - 1
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        run = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + run[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out.append(run)
        before = run
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """As ``lzw_decode`` reads them, whose table is one entry behind this one."""
    wide = lambda following: 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    codes, table, run = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    following = 258
    for b in data:
        longer = run + bytes([b])
        if longer in table:
            run = longer
            continue
        codes.append((table[run], wide(following)))
        table[longer] = following
        following += 1
        run = bytes([b])
        if following == 4095:
            codes.append((256, 12))
            table, following = {bytes([k]): k for k in range(256)}, 258
    if run:
        codes.append((table[run], wide(following)))
    codes.append((257, wide(following + 1)))
    text = "".join(f"{c:0{n}b}" for c, n in codes)
    text += "0" * (-len(text) % 8)
    return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:]


_REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(-1, 8)[:, ::-1], axis=1).reshape(-1).tobytes()


@dataclass
class Page:
    """One directory of a file: its tags, and its parts when they are asked for."""

    file: BinaryIO
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def tag(self, number: int, default: int = 1) -> int:
        return self.tags.get(number, (default,))[0]

    @property
    def width(self) -> int:
        return self.tags[WIDTH][0]

    @property
    def height(self) -> int:
        return self.tags[HEIGHT][0]

    @property
    def channels(self) -> int:
        return 4 if self.tag(SAMPLES) >= 4 else 3

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(x, y, values) of each strip or tile, cut at the bounds of the page; (h, w, 3 or 4) of 16-bit values."""
        tiled = TILES in self.tags
        offsets, sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        pw = self.tags[TILE_WIDTH][0] if tiled else self.width
        ph = self.tags[TILE_HEIGHT][0] if tiled else min(self.tag(STRIP_ROWS, self.height), self.height)
        across, down = -(-self.width // pw), -(-self.height // ph)
        n, planes = self.tag(SAMPLES), self.tag(PLANAR) == 2
        for k in range(across * down):
            x, y = k % across * pw, k // across * ph
            h = ph if tiled else min(ph, self.height - y)
            if planes:
                v = np.concatenate([self._samples(offsets[k + c * across * down], sizes[k + c * across * down], pw, h, 1) for c in range(n)], axis=2)
            else:
                v = self._samples(offsets[k], sizes[k], pw, h, n)
            yield x, y, self._colors(v[: self.height - y, : self.width - x])

    def image(self) -> np.ndarray:
        out = np.zeros((self.height, self.width, self.channels), np.int32)
        for x, y, v in self.parts():
            out[y : y + v.shape[0], x : x + v.shape[1]] = v
        return out

    def _samples(self, offset: int, size: int, w: int, h: int, n: int) -> np.ndarray:
        self.file.seek(offset)
        data, packing, bits = self.file.read(size), self.tag(PACKING), self.tag(BITS)
        if self.tag(FILL) == 2:
            data = data.translate(_REVERSED)
        if packing in (HUFFMAN, GROUP3, GROUP4):
            return ccitt.decode(data, w, h, packing, bool(self.tag(FAX3, 0) & 1)).reshape(h, w, 1).astype(np.int64)
        if packing in (DEFLATE, OLD_DEFLATE):
            data = zlib.decompress(data)
        elif packing == LZW:
            data = lzw_decode(data)
        elif packing == PACKBITS:
            data = _packbits(data)
        elif packing != PLAIN:
            raise ValueError(f"TIFF compression {packing} isn't read")
        if bits in (8, 16):
            v = np.frombuffer(data, np.uint8 if bits == 8 else self.order + "u2", h * w * n).reshape(h, w, n).astype(np.int64)
        else:
            line = (w * n * bits + 7) // 8
            flat = np.unpackbits(np.frombuffer(data, np.uint8, h * line).reshape(h, line), axis=1)[:, : w * n * bits]
            v = (flat.reshape(h, w, n, bits) << np.arange(bits)[::-1]).sum(3, dtype=np.int64)
        return np.cumsum(v, axis=1) & (1 << bits) - 1 if self.tag(PREDICTOR) == 2 else v

    def _colors(self, v: np.ndarray) -> np.ndarray:
        kind, top = self.tag(PHOTOMETRIC, 2), (1 << self.tag(BITS)) - 1
        if kind == 3:
            return np.array(self.tags[COLORS], np.int32).reshape(3, -1).T[v[:, :, 0]]
        v = (v * 65535 // top).astype(np.int32)
        if kind == 0:
            v = 65535 - v
        return v[:, :, :4] if v.shape[2] >= 3 else v[:, :, :1].repeat(3, axis=2)


def pages(file: BinaryIO) -> Iterator[Page]:
    """The directories of a file in order; none is read twice, whatever they point to."""
    file.seek(0)
    head = file.read(16)
    order = "<" if head[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        file.seek(at)
        n = struct.unpack(order + count, file.read(struct.calcsize(count)))[0]
        body = file.read(n * entry + word)
        page = Page(file, order)
        for k in range(n):
            tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), body, entry * k)
            code = KINDS.get(kind)
            if not code:
                continue
            size = struct.calcsize(code) * many
            place = entry * k + (12 if big else 8)
            if size <= word:
                value = body[place : place + size]
            else:
                file.seek(struct.unpack_from(order + ("Q" if big else "I"), body, place)[0])
                value = file.read(size)
            page.tags[tag] = struct.unpack(f"{order}{many}{code}", value)
        yield page
        at = struct.unpack_from(order + ("Q" if big else "I"), body, n * entry)[0]


def decode(data: bytes) -> np.ndarray:
    """The first page."""
    for page in pages(io.BytesIO(data)):
        return page.image()
    raise ValueError("no page in the file")


def _packed(v: np.ndarray, packing: int, two_dimensional: bool) -> bytes:
    if packing in (HUFFMAN, GROUP3, GROUP4):
        return ccitt.encode(v[:, :, 0], packing, two_dimensional)
    data = v.astype("<u2").tobytes()
    return zlib.compress(data) if packing == DEFLATE else lzw_encode(data) if packing == LZW else data


def encode(images: list[np.ndarray], packing: int = DEFLATE, tile: int | None = None, strip_rows: int | None = None, two_dimensional: bool = False) -> bytes:
    """Pages of 16 bits a channel, in tiles of a side or strips of some rows; fax packings write black where luma is below half."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for p in images:
        h, w, n = p.shape
        fax = packing in (HUFFMAN, GROUP3, GROUP4)
        v = (p[:, :, :3] @ np.array([0.2126, 0.7152, 0.0722]) < 32767.5).astype(np.uint8)[:, :, None] if fax else p
        if tile:
            v = np.pad(v, ((0, -h % tile), (0, -w % tile), (0, 0)), mode="edge")
            parts = [v[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            rows = strip_rows or h
            parts = [v[y : y + rows] for y in range(0, h, rows)]
        places, sizes = [], []
        for part in parts:
            body = _packed(part, packing, two_dimensional)
            places.append(len(out))
            sizes.append(len(body))
            out += body + b"\0" * (len(body) % 2)
        n = 1 if fax else n
        tags = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [1 if fax else 16] * n), PACKING: ("H", [packing]), PHOTOMETRIC: ("H", [0 if fax else 2]), SAMPLES: ("H", [n])}
        tags |= {TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILES: ("I", places), TILE_BYTES: ("I", sizes)} if tile else {STRIP_ROWS: ("I", [strip_rows or h]), STRIPS: ("I", places), STRIP_BYTES: ("I", sizes)}
        if packing == GROUP3:
            tags[FAX3] = ("I", [int(two_dimensional)])
        if n == 4:
            tags[EXTRA] = ("H", [2])
        entries = b""
        for number in sorted(tags):
            code, values = tags[number]
            value = struct.pack(f"<{len(values)}{code}", *values)
            if len(value) > 4:
                place = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack("<I", place)
            entries += struct.pack("<HHI", number, 3 if code == "H" else 4, len(values)) + value.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
