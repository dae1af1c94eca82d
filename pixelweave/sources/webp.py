"""WebP files: lossless images (VP8L) both ways, extended files, and animations as one canvas a frame.

The lossy kind (VP8) is not read: its entropy coder starts from two fixed tables of 1,056 probabilities each, which no rule
gives. Such files are rows with an error.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np

from .codecs import _bytes, _with_alpha

#: Fixed values of the format: the order in which code lengths are sent, and the alphabets of a group but the first.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
ALPHABETS = (256, 256, 256, 40)
LITERALS, LENGTHS = 256, 24
#: Distances below 121 are places near the pixel: by distance, then from far above to the same row, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, INDEXED = range(4)
BLOCK_BITS = 4


class Bits:
    """Bits of a byte string, least first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.held = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.held < n:
            part = self.data[self.at : self.at + 8]
            self.buffer |= int.from_bytes(part, "little") << self.held
            self.at += 8
            self.held += 64
            if self.at > len(self.data) + 64:
                raise ValueError("the image data ends early")
        return self.buffer & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.buffer >>= n
        self.held -= n

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value


def _codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical code of each symbol with one, its bits reversed: symbol → (code, length)."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, symbol) for symbol, n in enumerate(lengths) if n):
        code <<= n - before
        out[symbol] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, before = code + 1, n
    return out


class Prefix:
    """A prefix code as a table over the next bits; a lone symbol takes none."""

    def __init__(self, lengths: list[int]):
        codes = _codes(lengths)
        if not codes:
            raise ValueError("an empty prefix code")
        self.lone = next(iter(codes)) if len(codes) == 1 else None
        self.bits = max(n for _, n in codes.values())
        self.table: list[tuple[int, int]] = [(-1, 1)] * (1 << self.bits)
        for symbol, (code, n) in codes.items():
            for k in range(code, 1 << self.bits, 1 << n):
                self.table[k] = (symbol, n)

    def read(self, bits: Bits) -> int:
        if self.lone is not None:
            return self.lone
        symbol, n = self.table[bits.peek(self.bits)]
        if symbol < 0:
            raise ValueError("no such prefix code")
        bits.skip(n)
        return symbol


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Prefix(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.take(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.take(3)
    code = Prefix(of_lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, before = 0, 8
    while at < size and left > 0:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        value, extra, least = {16: (before, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[symbol]
        n = least + bits.take(extra)
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return Prefix(lengths)


def _read_number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _read_pixels(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """ARGB words (h, w) of an entropy-coded image; only the main one may have several groups of codes."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    groups, block, rows = 1, 0, None
    if main and bits.take(1):
        block = 2 + bits.take(3)
        found = _read_pixels(bits, -(-w >> block), -(-h >> block), False)
        rows = (found >> 8 & 0xFFFF).tolist()
        groups = 1 + max(map(max, rows))
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), *ALPHABETS)
    codes = [[_read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    out, cache, behind, total = [0] * (w * h), [0] * (1 << cache_bits), 0, w * h
    at = 0
    while at < total:
        green, red, blue, alpha, distance = codes[rows[at // w >> block][at % w >> block]] if rows else codes[0]
        symbol = green.read(bits)
        if symbol < LITERALS:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < LITERALS + LENGTHS:
            n = _read_number(bits, symbol - LITERALS)
            far = _read_number(bits, distance.read(bits))
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                x, y = NEAR[far - 1]
                far = max(x + y * w, 1)
            if far > at or at + n > total:
                raise ValueError("a copy from outside the image")
            for k in range(at, at + n):
                out[k] = out[k - far]
            at += n
        else:
            if cache_bits:
                while behind < at:
                    cache[(0x1E35A7BD * out[behind] & 0xFFFFFFFF) >> 32 - cache_bits] = out[behind]
                    behind += 1
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.int64).reshape(h, w)


def _planes(words: np.ndarray) -> np.ndarray:
    """(h, w, 4) as alpha, red, green, blue."""
    return np.stack([words >> s & 255 for s in (24, 16, 8, 0)], axis=2)


def _predictions(mode: int, left, top, corner, right) -> np.ndarray:
    """What a mode expects of a pixel from those to the left, above, above left and above right (last axis: channels)."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        guess = np.abs(top - corner).sum(-1), np.abs(left - corner).sum(-1)
        return np.where((guess[0] < guess[1])[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = mean(left, top)
        return np.clip(m + np.fix((m - corner) / 2).astype(np.int64), 0, 255)
    black = np.zeros_like(left)
    black[..., 0] = 255
    return [black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right))][mode] if mode < 11 else black


def _unpredict(p: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = p.shape
    out = np.zeros_like(p)
    out[0, 0] = (p[0, 0] + [255, 0, 0, 0]) & 255
    out[0, 1:] = (out[0, 0] + np.cumsum(p[0, 1:], axis=0)) & 255
    for y in range(1, h):
        above, row = out[y - 1], out[y]
        row[0] = (p[y, 0] + above[0]) & 255
        # above right of the last pixel is the first of its own row
        right = np.concatenate([above[1:], row[:1]])
        x = 1
        while x < w:
            mode, end = int(modes[y >> bits, x >> bits]), min(w, ((x >> bits) + 1) << bits)
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:  # nothing of this row is needed
                row[x:end] = (p[y, x:end] + _predictions(mode, above[x:end], above[x:end], above[x - 1 : end - 1], right[x:end])) & 255
            elif mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(p[y, x:end], axis=0)) & 255
            else:
                for k in range(x, end):
                    row[k] = (p[y, k] + _predictions(mode, row[k - 1], above[k], above[k - 1], right[k])) & 255
            x = end
    return out


def _signed(v: np.ndarray) -> np.ndarray:
    return ((v & 255) ^ 128) - 128


def _spread(v: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return v.repeat(1 << bits, 0).repeat(1 << bits, 1)[:h, :w]


def vp8l_decode(data: bytes) -> np.ndarray:
    """(h, w, 4) bytes as red, green, blue, alpha of a VP8L chunk."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("no lossless image data")
    w, h = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("an unknown version")
    transforms, width = [], w
    while bits.take(1):
        kind = bits.take(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            size = 2 + bits.take(3)
            transforms.append((kind, size, width, _read_pixels(bits, -(-width >> size), -(-h >> size), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, 0, width, None))
        else:
            n = bits.take(8) + 1
            table = np.cumsum(_planes(_read_pixels(bits, n, 1, False)), axis=1)[0] & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, pack, width, table))
            width = -(-width >> pack)
    p = _planes(_read_pixels(bits, width, h, True))
    for kind, size, wide, more in reversed(transforms):
        if kind == SUBTRACT_GREEN:
            p[:, :, (1, 3)] = (p[:, :, (1, 3)] + p[:, :, 2:3]) & 255
        elif kind == PREDICTOR:
            p = _unpredict(p, more >> 8 & 255, size)
        elif kind == CROSS_COLOR:
            to_red, to_blue, red_to_blue = (_spread(_signed(more >> s), size, h, wide) for s in (0, 8, 16))
            green = _signed(p[:, :, 2])
            p[:, :, 1] = (p[:, :, 1] + (to_red * green >> 5)) & 255
            p[:, :, 3] = (p[:, :, 3] + (to_blue * green >> 5) + (red_to_blue * _signed(p[:, :, 1]) >> 5)) & 255
        else:
            each = 8 >> size
            index = p[:, :, 2]
            if size:
                index = (index[:, :, None] >> each * np.arange(1 << size) & (1 << each) - 1).reshape(h, -1)[:, :wide]
            full = np.zeros((256, 4), np.int64)
            full[: len(more)] = more
            p = full[index]
    return p[:, :, (1, 2, 3, 0)]


# --- writing ------------------------------------------------------------------------------------------------------------------------


class Writer:
    def __init__(self):
        self.parts, self.buffer, self.held = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.buffer |= value << self.held
        self.held += n
        while self.held >= 8:
            self.parts.append(self.buffer & 255)
            self.buffer >>= 8
            self.held -= 8

    def bytes(self) -> bytes:
        return bytes(self.parts) + (bytes([self.buffer & 255]) if self.held else b"")


def _code_lengths(counts: np.ndarray, most: int = 15) -> list[int]:
    """Lengths of a prefix code for counts; counts are flattened until none is longer than ``most``."""
    counts = np.asarray(counts, np.int64)
    some = np.flatnonzero(counts)
    lengths = [0] * len(counts)
    if len(some) <= 1:
        lengths[some[0] if len(some) else 0] = 1
        return lengths
    while True:
        heap = [(int(counts[s]), int(s), (int(s),)) for s in some]
        heapq.heapify(heap)
        deep = dict.fromkeys(some.tolist(), 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                deep[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(deep.values()) <= most:
            for s, n in deep.items():
                lengths[s] = n
            return lengths
        counts = (counts + 1) // 2


def _write_prefix(out: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(used[0], 8)
        return {used[0]: (0, 0)}
    symbols = []
    for n, same in groupby(lengths):
        left = len(list(same))
        while n == 0 and left >= 3:
            run = min(left, 138)
            symbols.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            left -= run
        symbols += [(n, 0, 0)] * left
    of_lengths = _code_lengths(np.bincount([s for s, _, _ in symbols], minlength=19), 7)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(of_lengths[s], 3)
    out.put(0, 1)
    codes = _codes(of_lengths)
    lone = len(codes) == 1
    for s, value, n in symbols:
        if not lone:
            out.put(*codes[s])
        out.put(value, n)
    found = _codes(lengths)
    return found if len(found) > 1 else {s: (0, 0) for s in found}


def _number(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + (v >> extra & 1), v & (1 << extra) - 1, extra


def _copies(words: np.ndarray, w: int) -> Iterator[tuple[int, int, int]]:
    """(place, length, distance code) of runs that repeat the pixel before or the row above; length 0: a pixel by itself."""
    flat, n = words.reshape(-1), words.size
    ends = []
    for far in (1, w):
        same = np.zeros(n, bool)
        same[far:] = flat[far:] == flat[: n - far]
        stop = np.where(same, n, np.arange(n))
        ends.append(np.minimum.accumulate(stop[::-1])[::-1])
    at = 0
    while at < n:
        run, code = max((int(ends[0][at]) - at, 2), (int(ends[1][at]) - at, 1))
        if run < 3:
            yield at, 0, 0
            at += 1
        else:
            run = min(run, 4096)
            yield at, run, code
            at += run


def _write_pixels(out: Writer, words: np.ndarray, main: bool) -> None:
    out.put(0, 1)  # no colour cache
    if main:
        out.put(0, 1)  # one group of codes
    flat = words.reshape(-1).tolist()
    steps = list(_copies(words, words.shape[1]))
    counts = [np.zeros(n, np.int64) for n in (LITERALS + LENGTHS, *ALPHABETS)]
    for at, run, code in steps:
        if run:
            counts[0][LITERALS + _number(run)[0]] += 1
            counts[4][_number(code)[0]] += 1
        else:
            v = flat[at]
            for table, shift in zip(counts, (8, 16, 0, 24), strict=False):
                table[v >> shift & 255] += 1
    codes = [_write_prefix(out, _code_lengths(c)) for c in counts]
    for at, run, code in steps:
        if run:
            prefix, value, n = _number(run)
            out.put(*codes[0][LITERALS + prefix])
            out.put(value, n)
            prefix, value, n = _number(code)
            out.put(*codes[4][prefix])
            out.put(value, n)
        else:
            v = flat[at]
            for table, shift in zip(codes, (8, 16, 0, 24), strict=False):
                out.put(*table[v >> shift & 255])


def _words(p: np.ndarray) -> np.ndarray:
    return p[:, :, 0] << 24 | p[:, :, 1] << 16 | p[:, :, 2] << 8 | p[:, :, 3]


def vp8l_encode(rgba: np.ndarray) -> bytes:
    """A VP8L chunk of (h, w, 4) bytes: green is taken off, each block is predicted by the mode that leaves least."""
    p = rgba[:, :, (3, 0, 1, 2)].astype(np.int64)
    h, w, _ = p.shape
    out = Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((p[:, :, 0] < 255).any()), 1)
    out.put(0, 3)
    out.put(1, 1)
    out.put(SUBTRACT_GREEN, 2)
    p[:, :, (1, 3)] = (p[:, :, (1, 3)] - p[:, :, 2:3]) & 255
    if h > 1 and w > 1:
        left, top, corner = (np.zeros_like(p) for _ in range(3))
        left[:, 1:], top[1:], corner[1:, 1:] = p[:, :-1], p[:-1], p[:-1, :-1]
        right = np.zeros_like(p)
        right[1:, :-1], right[1:, -1] = p[:-1, 1:], p[1:, 0]
        bh, bw = -(-h >> BLOCK_BITS), -(-w >> BLOCK_BITS)
        block = (np.arange(h) >> BLOCK_BITS)[:, None] * bw + (np.arange(w) >> BLOCK_BITS)
        guesses = [_predictions(mode, left, top, corner, right) for mode in range(14)]
        costs = np.array([np.bincount(block.reshape(-1), np.abs(_signed(p - g)).sum(2).reshape(-1), bh * bw) for g in guesses])
        modes = costs.argmin(0).reshape(bh, bw)
        chosen = _spread(modes, BLOCK_BITS, h, w)
        guess = np.choose(chosen[..., None], guesses)
        guess[0, 1:], guess[1:, 0], guess[0, 0] = left[0, 1:], top[1:, 0], (255, 0, 0, 0)
        p = (p - guess) & 255
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(BLOCK_BITS - 2, 3)
        _write_pixels(out, modes << 8 | 0xFF000000, False)
    out.put(0, 1)
    _write_pixels(out, _words(p), True)
    return out.bytes()


# --- files --------------------------------------------------------------------------------------------------------------------------


def _chunks(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _u24(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 3], "little")


def _image(chunks: Iterator[tuple[bytes, bytes]]) -> np.ndarray:
    for kind, body in chunks:
        if kind == b"VP8L":
            return vp8l_decode(body)
        if kind == b"VP8 ":
            raise ValueError("lossy WebP isn't read")
    raise ValueError("no image in the file")


def frames(data: bytes) -> list[dict]:
    """Frames as they stand in the file: pixels (h, w, 4), x, y, delay (ms), dispose, blend; a still image is one."""
    out = []
    for kind, body in _chunks(data, 12):
        if kind == b"ANMF":
            out.append({"pixels": _image(_chunks(body, 16)).astype(np.int32) * 257, "x": 2 * _u24(body, 0), "y": 2 * _u24(body, 3), "delay": _u24(body, 12), "dispose": "background" if body[15] & 1 else "none", "blend": not body[15] & 2})
    return out or [{"pixels": _image(_chunks(data, 12)).astype(np.int32) * 257, "x": 0, "y": 0, "delay": 0, "dispose": "none", "blend": False}]


def canvas_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) that an extended file states."""
    return (1 + _u24(data, 24), 1 + _u24(data, 27)) if data[12:16] == b"VP8X" else None


def decode(data: bytes) -> np.ndarray:
    """The (first) image; alpha only where something is transparent."""
    p = frames(data)[0]["pixels"]
    return p if (p[:, :, 3] < 65535).any() else p[:, :, :3]


def _riff(body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def encode(p: np.ndarray) -> bytes:
    return _riff(_chunk(b"VP8L", vp8l_encode(_bytes(_with_alpha(p)))))


def encode_sequence(images: list[np.ndarray], delays: list[int] | None = None, loops: int = 0) -> bytes:
    """An animation of frames of one size, each replacing the one before; delays in milliseconds."""
    h, w = images[0].shape[:2]
    u24 = lambda v: v.to_bytes(3, "little")
    body = _chunk(b"VP8X", b"\x12\0\0\0" + u24(w - 1) + u24(h - 1)) + _chunk(b"ANIM", b"\0\0\0\0" + struct.pack("<H", loops))
    for k, p in enumerate(images):
        head = u24(0) * 2 + u24(w - 1) + u24(h - 1) + u24((delays or [100] * len(images))[k]) + b"\x02"
        body += _chunk(b"ANMF", head + _chunk(b"VP8L", vp8l_encode(_bytes(_with_alpha(p)))))
    return _riff(body)
