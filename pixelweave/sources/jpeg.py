"""JPEG files by ITU T.81: baseline and progressive, 8 bits, restart intervals, any sampling; Huffman tables made for each file.

Coefficients of a component are one array of blocks: entropy coding is a loop, transforms and colours are numpy on all blocks.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np

#: The quantisers that the standard suggests for luma and chroma at quality 50, row by row.
LUMA_QUANTISER = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA_QUANTISER = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32

#: Places of a block (row * 8 + column) in the order of the file: along the antidiagonals, turn about.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: The orthonormal cosine transform of eight values.
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def quantiser(base: list[int], quality: int) -> np.ndarray:
    quality = min(max(quality, 1), 100)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def forward(blocks: np.ndarray) -> np.ndarray:
    return COSINES @ blocks @ COSINES.T


def inverse(blocks: np.ndarray) -> np.ndarray:
    return COSINES.T @ blocks @ COSINES


# --- reading ------------------------------------------------------------------------------------------------------------------------


def _lookup(counts: bytes, symbols: bytes) -> array:
    """For each 16 bits that may come next: length * 256 + symbol of the code they begin with (0: none). Two bytes each."""
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return array("H", out.tobytes())


class _Bits:
    """The bits of an entropy-coded segment; past its end come zeros."""

    __slots__ = ("data", "at", "held", "n", "run")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n, self.run = data, 0, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = (self.held & (1 << self.n) - 1) << 48 | int.from_bytes(part.ljust(6, b"\0"))
        self.n += 48

    def symbol(self, table: array) -> int:
        if self.n < 16:
            self.fill()
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found or self.at > len(self.data) + 64:
            raise ValueError("a code that the Huffman table doesn't hold, or a scan that is cut short")
        self.n -= found >> 8
        return found & 0xFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.n < n:
            self.fill()
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Part:
    """A component: sampling, quantiser, tables of the present scan, and its blocks in the order of the file."""

    def __init__(self, number: int, h: int, v: int, q: int):
        self.number, self.h, self.v, self.q = number, h, v, q
        self.dc = self.ac = None
        self.last = 0


def _block(bits: _Bits, part: _Part, block: list[int], begin: int, end: int, high: int, low: int, progressive: bool) -> None:
    """Decode one block's share of a scan: coefficients begin to end at bit ``low``, the first time if ``high`` is 0."""
    if begin == 0:
        if high:
            block[0] |= bits.take(1) << low
        else:
            part.last += bits.signed(bits.symbol(part.dc))
            block[0] = part.last << low
        if progressive:
            return
    k = max(begin, 1)
    if high:
        _refine(bits, part, block, k, end, 1 << low)
        return
    if bits.run:
        bits.run -= 1
        return
    while k <= end:
        s = bits.symbol(part.ac)
        zeros, size = s >> 4, s & 15
        if size:
            k += zeros
            if k > 63:
                raise ValueError("a block of more than 64 coefficients")
            block[k] = bits.signed(size) << low
            k += 1
        elif zeros == 15:
            k += 16
        else:
            bits.run = (1 << zeros) - 1 + bits.take(zeros)
            return


def _refine(bits: _Bits, part: _Part, block: list[int], k: int, end: int, one: int) -> None:
    def better(at: int) -> None:
        if bits.take(1) and not abs(block[at]) & one:
            block[at] += one if block[at] > 0 else -one

    while k <= end and not bits.run:
        s = bits.symbol(part.ac)
        zeros, size = s >> 4, s & 15
        if not size and zeros < 15:
            bits.run = (1 << zeros) + bits.take(zeros)
            break
        new = (one if bits.take(1) else -one) if size else 0
        while k <= end:
            if block[k]:
                better(k)
            elif zeros:
                zeros -= 1
            else:
                block[k] = new
                k += 1
                break
            k += 1
    if bits.run:
        for at in range(k, end + 1):
            if block[at]:
                better(at)
        bits.run -= 1


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded data from ``at`` on, cut at restart markers and without stuffed bytes, and where it ends."""
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            end = len(data)
            break
        if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
            end += 2
        elif data[end + 1] == 0xFF:
            end += 1
        else:
            break
    parts, begin, k = [], at, at
    while (k := data.find(b"\xff", k, end)) >= 0 and k + 1 < end:
        if 0xD0 <= data[k + 1] <= 0xD7:
            parts.append(data[begin:k])
            begin = k + 2
        k += 2
    return [p.replace(b"\xff\0", b"\xff") for p in [*parts, data[begin:end]]], end


def markers(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, payload, place after it) of each segment up to the end; the caller may send the place to go on from."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return
        if kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        end = at + 2 + size
        on = yield kind, data[at + 4 : end], end
        at = on if on is not None else end


def decode(data: bytes) -> np.ndarray:
    """(h, w, 3) of 16-bit values."""
    tables: dict[tuple[int, int], array] = {}
    quantisers: dict[int, np.ndarray] = {}
    parts: list[_Part] = []
    restart, adobe, progressive, w, h = 0, None, False, 0, 0
    walk = markers(bytes(data))
    on = None
    while True:
        try:
            kind, body, end = walk.send(on)
        except StopIteration:
            break
        on = None
        if kind == 0xDB:
            at = 0
            while at < len(body):
                wide, number = body[at] >> 4, body[at] & 15
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1)
                quantisers[number] = values.astype(np.int64)
                at += 1 + 64 * (2 if wide else 1)
        elif kind == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                tables[body[at] >> 4, body[at] & 15] = _lookup(counts, body[at + 17 : at + 17 + n])
                at += 17 + n
        elif kind in (0xC0, 0xC1, 0xC2):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not w or not h:
                raise ValueError("only 8 bits of a known size")
            progressive = kind == 0xC2
            parts = [_Part(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            for p in parts:
                p.most_h, p.most_v = max(x.h for x in parts), max(x.v for x in parts)
                p.across, p.down = -(-w // (8 * p.most_h)) * p.h, -(-h // (8 * p.most_v)) * p.v
                # blocks that a scan of this component alone holds
                p.own_across, p.own_down = -(-(-(-w * p.h // p.most_h)) // 8), -(-(-(-h * p.v // p.most_v)) // 8)
                p.blocks = [[0] * 64 for _ in range(p.across * p.down)]
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("a JPEG process that isn't Huffman-coded baseline or progressive")
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif kind == 0xDA:
            chosen = []
            for k in range(body[0]):
                part = next(p for p in parts if p.number == body[1 + 2 * k])
                part.dc, part.ac = tables.get((0, body[2 + 2 * k] >> 4)), tables.get((1, body[2 + 2 * k] & 15))
                chosen.append(part)
            begin, last, bit = body[1 + 2 * body[0] :][:3]
            pieces, on = _segments(bytes(data), end)
            _scan(chosen, pieces, restart, begin, last if progressive else 63, bit >> 4, bit & 15, progressive)
    if not parts:
        raise ValueError("no image in this file")
    planes = []
    for p in parts:
        values = np.zeros((p.down * p.across, 64))
        values[:, ZIGZAG] = np.array(p.blocks, np.int64) * quantisers[p.q]
        flat = inverse(values.reshape(-1, 8, 8)).reshape(p.down, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(p.down * 8, p.across * 8)
        flat = np.clip(np.rint(flat + 128), 0, 255)
        ys, xs = np.arange(h) * p.v // p.most_v, np.arange(w) * p.h // p.most_h
        planes.append(flat[ys][:, xs])
    return _colours(planes, adobe)


def _scan(chosen: list[_Part], pieces: list[bytes], restart: int, begin: int, end: int, high: int, low: int, progressive: bool) -> None:
    if len(chosen) == 1:
        part = chosen[0]
        units = [[(part, y * part.across + x)] for y in range(part.own_down) for x in range(part.own_across)]
    else:
        rows, columns = chosen[0].down // chosen[0].v, chosen[0].across // chosen[0].h
        units = [[(p, (my * p.v + y) * p.across + mx * p.h + x) for p in chosen for y in range(p.v) for x in range(p.h)] for my in range(rows) for mx in range(columns)]
    every = restart or len(units)
    for nth, piece in zip(range(0, len(units), every), pieces, strict=False):
        bits = _Bits(piece)
        for p in chosen:
            p.last = 0
        for unit in units[nth : nth + every]:
            for p, at in unit:
                # baseline blocks end on their own; a run of ends belongs to progressive scans
                _block(bits, p, p.blocks[at], begin, end, high, low, progressive)


def _colours(planes: list[np.ndarray], adobe: int | None) -> np.ndarray:
    if len(planes) == 1:
        rgb = np.stack([planes[0]] * 3, axis=2)
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        as_rgb = adobe == 0 if len(planes) == 3 else adobe != 2
        rgb = np.stack(planes[:3] if as_rgb else [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        if len(planes) == 4:  # inks, written inverted
            rgb = np.clip(rgb, 0, 255) * planes[3][..., None] / 255
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.int32) * 257


# --- writing ------------------------------------------------------------------------------------------------------------------------


def huffman(counts: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """(numbers of codes by length, symbols, code and length of each) of a table of up to 16 bits, without the code of all ones."""
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted({**counts, 256: 0}.items()))]
    sizes = dict.fromkeys([*counts, 256], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, one), (b, k, two) = heapq.heappop(heap), heapq.heappop(heap)
        for s in one + two:
            sizes[s] += 1
        heapq.heappush(heap, (a + b, 1000 + len(heap) * 1000 + k, one + two))
    number = [0] * (max(sizes.values()) + 2)
    for n in sizes.values():
        number[n] += 1
    # longer codes: two of a length become one shorter, and a shorter one becomes two
    for n in range(len(number) - 1, 16, -1):
        while number[n] > 0:
            k = n - 2
            while not number[k]:
                k -= 1
            number[n] -= 2
            number[n - 1] += 1
            number[k + 1] += 2
            number[k] -= 1
    number = (number + [0] * 17)[:17]
    # the symbol that stands for nothing has the last code
    longest = max(k for k in range(17) if number[k])
    number[longest] -= 1
    order = sorted(counts, key=lambda s: (sizes[s], s))
    codes, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(number[length]):
            codes[order[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return bytes(number[1:]), bytes(order), codes


def _symbols(block: list[int], before: int, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(table, symbol, extra bits, their number) of a block's coefficients begin to end; ``before``: the last block's first one."""
    if begin == 0:
        d = block[0] - before
        n = abs(d).bit_length()
        yield 0, n, d if d >= 0 else d + (1 << n) - 1, n
        begin = 1
    run = 0
    for k in range(begin, end + 1):
        v = block[k]
        if not v:
            run += 1
            continue
        while run > 15:
            yield 1, 0xF0, 0, 0
            run -= 16
        n = abs(v).bit_length()
        yield 1, run << 4 | n, v if v >= 0 else v + (1 << n) - 1, n
        run = 0
    if run:
        yield 1, 0, 0, 0


def encode(pixels: np.ndarray, quality: int = 85, sampling: str = "444", progressive: bool = False) -> bytes:
    """A file of an (h, w, 3 or 4) array of 16-bit values; alpha is left out. Sampling 444, 422 or 420."""
    v = pixels[..., :3].astype(np.int64) + 128
    rgb = (v - (v >> 8) >> 8).astype(float)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128]
    h, w = r.shape
    fx, fy = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}[sampling]
    tables = [quantiser(LUMA_QUANTISER, quality), quantiser(CHROMA_QUANTISER, quality)]
    parts = []
    for k, plane in enumerate(planes):
        across, down = -(-w // (8 * fx)) * fx * 8, -(-h // (8 * fy)) * fy * 8
        plane = np.pad(plane, ((0, down - h), (0, across - w)), mode="edge")
        part = _Part(k + 1, *((fx, fy) if k == 0 else (1, 1)), min(k, 1))
        if k:
            plane = plane.reshape(down // fy, fy, across // fx, fx).mean(axis=(1, 3))
        part.down, part.across = plane.shape[0] // 8, plane.shape[1] // 8
        part.own_across, part.own_down = (-(-(-(-n * a // f)) // 8) for n, a, f in ((w, part.h, fx), (h, part.v, fy)))
        blocks = forward(plane.reshape(part.down, 8, part.across, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8) - 128).reshape(-1, 64)
        part.blocks = np.rint(blocks / tables[part.q])[:, ZIGZAG].astype(np.int64).tolist()
        parts.append(part)
    out = [b"\xff\xd8\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0101, 0, 1, 1, 0, 0)]
    for k, t in enumerate(tables):
        out.append(b"\xff\xdb" + struct.pack(">HB", 67, k) + bytes(t[ZIGZAG].tolist()))
    out.append(bytes([0xFF, 0xC2 if progressive else 0xC0]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"".join(bytes([p.number, p.h << 4 | p.v, p.q]) for p in parts))
    scans = [(parts, 0, 0), *[([p], a, b) for a, b in ((1, 5), (6, 63)) for p in parts]] if progressive else [(parts, 0, 63)]
    for chosen, begin, end in scans:
        out.append(_write_scan(chosen, begin, end))
    return b"".join(out) + b"\xff\xd9"


def _write_scan(chosen: list[_Part], begin: int, end: int) -> bytes:
    if len(chosen) == 1:
        p = chosen[0]
        places = [(p, y * p.across + x) for y in range(p.own_down) for x in range(p.own_across)]
    else:
        rows, columns = chosen[0].down // chosen[0].v, chosen[0].across // chosen[0].h
        places = [(p, (my * p.v + y) * p.across + mx * p.h + x) for my in range(rows) for mx in range(columns) for p in chosen for y in range(p.v) for x in range(p.h)]
    last = dict.fromkeys((p.number for p in chosen), 0)
    found, counts = [], {}
    for p, at in places:
        for table, symbol, extra, n in _symbols(p.blocks[at], last[p.number], begin, end):
            key = (table, p.q)
            counts.setdefault(key, {})
            counts[key][symbol] = counts[key].get(symbol, 0) + 1
            found.append((key, symbol, extra, n))
        last[p.number] = p.blocks[at][0]
    out, codes = [], {}
    for key in sorted(counts):
        number, symbols, codes[key] = huffman(counts[key])
        out.append(b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), key[0] << 4 | key[1]) + number + symbols)
    out.append(b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(chosen), len(chosen)) + b"".join(bytes([p.number, p.q << 4 | p.q]) for p in chosen) + bytes([begin, end, 0]))
    held, n, raw = 0, 0, bytearray()
    for key, symbol, extra, size in found:
        code, length = codes[key][symbol]
        held = (held << length | code) << size | extra
        n += length + size
        if n >= 64:
            raw += (held >> (n & 7)).to_bytes(n >> 3)
            n &= 7
            held &= (1 << n) - 1
    if n:
        raw += ((held << -n % 8) | (1 << -n % 8) - 1).to_bytes(-(-n // 8))
    return b"".join([*out, bytes(raw).replace(b"\xff", b"\xff\0")])
