"""More image files: one-bit, run-length, palette, scientific and high-range formats. Same contract as ``codecs``."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

from .codecs import _bytes, _with_alpha

#: Luma weights for formats of one channel.
GRAY = np.array([0.2126, 0.7152, 0.0722])


def _spread(v: np.ndarray) -> np.ndarray:
    """One 8-bit channel as three 16-bit ones."""
    return (v.astype(np.int32) * 257)[:, :, None].repeat(3, axis=2)


def _bits(p: np.ndarray) -> np.ndarray:
    """True where luma reaches the middle."""
    return p[:, :, :3] @ GRAY >= 32767.5


# --- one bit ------------------------------------------------------------------------------------------------------------------------


def _multi(n: int) -> bytes:
    out = [n & 127]
    while n > 127:
        n >>= 7
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def wbmp_encode(p: np.ndarray) -> bytes:
    return b"\0\0" + _multi(p.shape[1]) + _multi(p.shape[0]) + np.packbits(_bits(p), axis=1).tobytes()


def wbmp_decode(data: bytes) -> np.ndarray:
    at, sizes = 2, []
    for _ in range(2):
        n = 0
        while True:
            n, at = n << 7 | data[at] & 127, at + 1
            if not data[at - 1] & 128:
                break
        sizes.append(n)
    w, h = sizes
    rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
    return _spread(np.unpackbits(rows, axis=1)[:, :w] * 255)


def xbm_encode(p: np.ndarray) -> bytes:
    rows = np.packbits(~_bits(p), axis=1, bitorder="little")
    body = ", ".join(f"0x{b:02x}" for b in rows.reshape(-1))
    return f"#define image_width {p.shape[1]}\n#define image_height {p.shape[0]}\nstatic unsigned char image_bits[] = {{ {body} }};\n".encode()


def xbm_decode(data: bytes) -> np.ndarray:
    text = data.decode("latin-1")
    w, h = (int(re.search(rf"#define\s+\w*_{k}\s+(\d+)", text)[1]) for k in ("width", "height"))
    values = np.array([int(x, 16) for x in re.findall(r"0[xX]([0-9a-fA-F]+)", text[text.index("{") :])], np.uint8)
    bits = np.unpackbits(values[: h * ((w + 7) // 8)].reshape(h, -1), axis=1, bitorder="little")[:, :w]
    return _spread((1 - bits) * 255)


# --- run lengths --------------------------------------------------------------------------------------------------------------------


def pcx_encode(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    line = w + w % 2
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 8, 0, 0, w - 1, h - 1, 72, 72) + bytes(48) + struct.pack("<BBHHHH", 0, 3, line, 1, 0, 0) + bytes(54)
    out = bytearray(head)
    v = np.zeros((h, 3, line), np.uint8)
    v[:, :, :w] = _bytes(p[:, :, :3]).transpose(0, 2, 1)
    for row in v.reshape(h * 3, line).tolist():
        at = 0
        while at < line:
            n = 1
            while n < 63 and at + n < line and row[at + n] == row[at]:
                n += 1
            out += bytes([0xC0 | n, row[at]]) if n > 1 or row[at] >= 0xC0 else bytes([row[at]])
            at += n
    return bytes(out)


def pcx_decode(data: bytes) -> np.ndarray:
    x0, y0, x1, y1 = struct.unpack_from("<HHHH", data, 4)
    planes, line = data[65], struct.unpack_from("<H", data, 66)[0]
    w, h = x1 - x0 + 1, y1 - y0 + 1
    out, at = bytearray(), 128
    while len(out) < h * planes * line:
        b, at = data[at], at + 1
        if b >= 0xC0:
            out += bytes([data[at]]) * (b & 63)
            at += 1
        else:
            out.append(b)
    v = np.frombuffer(bytes(out[: h * planes * line]), np.uint8).reshape(h, planes, line)[:, :, :w]
    if planes == 1:
        return np.frombuffer(data[-768:], np.uint8).reshape(256, 3)[v[:, 0]].astype(np.int32) * 257
    return v.transpose(0, 2, 1).astype(np.int32) * 257


def sgi_encode(p: np.ndarray) -> bytes:
    """Planes from the bottom up, 16 bits, not packed."""
    h, w, n = p.shape
    return struct.pack(">HBBHHHHII", 474, 0, 2, 3, w, h, n, 0, 65535) + bytes(512 - 20) + p[::-1].transpose(2, 0, 1).astype(">u2").tobytes()


def sgi_decode(data: bytes) -> np.ndarray:
    _, packed, size, _, w, h, n = struct.unpack_from(">HBBHHHH", data)
    if packed:
        starts = np.frombuffer(data, ">u4", h * n, 512)
        v = np.zeros((n * h, w), np.int32)
        for k, at in enumerate(starts.tolist()):
            row: list[int] = []
            step = ">u2" if size == 2 else np.uint8
            while True:
                code = int(np.frombuffer(data, step, 1, at)[0])
                at += size
                count = code & 127
                if not count:
                    break
                if code & 128:
                    row += np.frombuffer(data, step, count, at).tolist()
                    at += size * count
                else:
                    row += [int(np.frombuffer(data, step, 1, at)[0])] * count
                    at += size
            v[k] = row[:w]
        v = v.reshape(n, h, w)
    else:
        v = np.frombuffer(data, ">u2" if size == 2 else np.uint8, n * h * w, 512).reshape(n, h, w).astype(np.int32)
    v = v.transpose(1, 2, 0)[::-1] * (1 if size == 2 else 257)
    return v.repeat(3, axis=2) if n == 1 else v


def sun_encode(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    line = np.zeros((h, w * 3 + w * 3 % 2), np.uint8)
    line[:, : w * 3] = _bytes(p[:, :, 2::-1]).reshape(h, -1)
    return struct.pack(">IIIIIIII", 0x59A66A95, w, h, 24, line.size, 1, 0, 0) + line.tobytes()


def sun_decode(data: bytes) -> np.ndarray:
    _, w, h, depth, size, kind, _, table = struct.unpack_from(">IIIIIIII", data)
    body = data[32 + table :]
    if kind == 2:
        out, at = bytearray(), 0
        line = (w * depth + 15) // 16 * 2
        while len(out) < line * h:
            if body[at] != 0x80:
                out.append(body[at])
                at += 1
            elif body[at + 1] == 0:
                out.append(0x80)
                at += 2
            else:
                out += bytes([body[at + 2]]) * (body[at + 1] + 1)
                at += 3
        body = bytes(out)
    line = (w * depth + 15) // 16 * 2
    rows = np.frombuffer(body, np.uint8, line * h).reshape(h, line)
    if depth == 1:
        return _spread((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255)
    if depth == 8:
        if table:
            colors = np.frombuffer(data, np.uint8, table, 32).reshape(3, -1).T
            return colors[rows[:, :w]].astype(np.int32) * 257
        return _spread(rows[:, :w])
    n = depth // 8
    v = rows[:, : w * n].reshape(h, w, n)[:, :, n - 3 :]
    return (v if kind == 3 else v[:, :, ::-1]).astype(np.int32) * 257


def pix_encode(p: np.ndarray) -> bytes:
    h, w = p.shape[:2]
    out = bytearray(struct.pack(">HHHHH", w, h, 0, 0, 24))
    for row in _bytes(p[:, :, 2::-1]).tolist():
        at = 0
        while at < w:
            n = 1
            while n < 255 and at + n < w and row[at + n] == row[at]:
                n += 1
            out += bytes([n, *row[at]])
            at += n
    return bytes(out)


def pix_decode(data: bytes) -> np.ndarray:
    w, h, _, _, depth = struct.unpack_from(">HHHHH", data)
    n, at, out = depth // 8, 10, []
    while len(out) < w * h:
        out += [data[at + 1 : at + 1 + n]] * data[at]
        at += 1 + n
    v = np.frombuffer(b"".join(out[: w * h]), np.uint8).reshape(h, w, n)
    return (v.repeat(3, axis=2) if n == 1 else v[:, :, ::-1]).astype(np.int32) * 257


# --- palettes -----------------------------------------------------------------------------------------------------------------------


def quantize(p: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(palette of bytes, index of each pixel): exact where there are few colours, else median cut and nearest colours."""
    v = _bytes(p[:, :, :3]).reshape(-1, 3)
    colors, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    if len(colors) > most:
        boxes = [np.arange(len(colors))]
        while len(boxes) < most:
            spread = [np.ptp(colors[b], axis=0).max() if len(b) > 1 else -1 for b in boxes]
            k = int(np.argmax(spread))
            if spread[k] < 0:
                break
            box = boxes.pop(k)
            axis = int(np.ptp(colors[box], axis=0).argmax())
            box = box[np.argsort(colors[box, axis], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(counts[box]), counts[box].sum() / 2) + 1, 1, len(box) - 1))
            boxes += [box[:half], box[half:]]
        palette = np.array([np.average(colors[b], axis=0, weights=counts[b]) for b in boxes]).round().astype(np.uint8)
        nearest = np.concatenate([((c[:, None].astype(int) - palette[None].astype(int)) ** 2).sum(2).argmin(1) for c in np.array_split(colors, max(1, len(colors) // 4096))])
        return palette, nearest[inverse].reshape(p.shape[:2])
    return colors, inverse.reshape(p.shape[:2])


def lzw_encode(codes: bytes, bits: int) -> bytes:
    """The variable-width codes of GIF, least bits first."""
    clear, stop = 1 << bits, (1 << bits) + 1
    out, buffer, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal buffer, held
        buffer |= code << held
        held += width
        while held >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            held -= 8

    table = {bytes([k]): k for k in range(clear)}
    width, following = bits + 1, stop + 1
    put(clear, width)
    run = b""
    for b in codes:
        longer = run + bytes([b])
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        if following < 4096:
            table[longer] = following
            if following == 1 << width:
                width += 1
            following += 1
        else:
            put(clear, width)
            table = {bytes([k]): k for k in range(clear)}
            width, following = bits + 1, stop + 1
        run = bytes([b])
    if run:
        put(table[run], width)
    put(stop, width)
    return bytes(out) + (bytes([buffer & 255]) if held else b"")


def lzw_decode(data: bytes, bits: int) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    out, buffer, held, at = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, before = bits + 1, b""
    while True:
        while held < width:
            if at >= len(data):
                return bytes(out)
            buffer |= data[at] << held
            held, at = held + 8, at + 1
        code = buffer & (1 << width) - 1
        buffer >>= width
        held -= width
        if code == clear:
            table = [bytes([k]) for k in range(clear)] + [b"", b""]
            width, before = bits + 1, b""
            continue
        if code == stop:
            return bytes(out)
        if not before:
            run = table[code]
        else:
            run = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + run[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out += run
        before = run


def gif_frame(index: np.ndarray, bits: int) -> bytes:
    body = lzw_encode(index.astype(np.uint8).tobytes(), bits)
    return bytes([bits]) + b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)) + b"\0"


def gif_encode(p: np.ndarray) -> bytes:
    return gif_encode_sequence([p])


def gif_encode_sequence(frames: list[np.ndarray], delays: list[int] | None = None, loops: int = 0) -> bytes:
    """Frames of one size with a palette each, as an animation where there are several; delays in hundredths of a second."""
    h, w = frames[0].shape[:2]
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x70, 0, 0)
    if len(frames) > 1:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    for k, p in enumerate(frames):
        palette, index = quantize(p)
        bits = max(2, int(len(palette) - 1).bit_length())
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(palette)] = palette
        if len(frames) > 1:
            out += b"\x21\xf9\x04\x04" + struct.pack("<H", (delays or [10] * len(frames))[k]) + b"\0\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x80 | bits - 1) + table.tobytes() + gif_frame(index, bits)
    return out + b"\x3b"


def gif_each_frame(data: bytes) -> Iterator[dict]:
    """Frames as they stand in the file, one at a time: pixels (h, w, 4), x, y, delay, dispose."""
    flags = data[10]
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    delay, dispose, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            at += 2
            if kind == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 1)
                dispose, clear = packed >> 2 & 7, index if packed & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        x, y, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        table = shared
        if packed & 0x80:
            n = 2 << (packed & 7)
            table = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        bits, at, body = data[at], at + 1, b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        index = np.frombuffer(lzw_decode(body, bits)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if packed & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            laced = np.empty_like(index)
            laced[rows] = index
            index = laced
        alpha = np.where(index == clear, 0, 65535) if clear is not None else np.full(index.shape, 65535)
        pixels = np.concatenate([table[np.minimum(index, len(table) - 1)].astype(np.int32) * 257, alpha[:, :, None]], axis=2)
        yield {"pixels": pixels, "x": x, "y": y, "delay": delay, "dispose": {2: "background", 3: "previous"}.get(dispose, "none")}
        delay, dispose, clear = 0, 0, None


def gif_frames(data: bytes) -> list[dict]:
    return list(gif_each_frame(data))


def gif_decode(data: bytes) -> np.ndarray:
    """The first frame; alpha only where something is transparent."""
    p = next(gif_each_frame(data))["pixels"]
    return p if (p[:, :, 3] < 65535).any() else p[:, :, :3]


def xpm_encode(p: np.ndarray) -> bytes:
    palette, index = quantize(p)
    signs = "".join(chr(c) for c in range(35, 127) if chr(c) != "\\")
    key = [signs[k % len(signs)] + signs[k // len(signs)] for k in range(len(palette))]
    lines = [f"{p.shape[1]} {p.shape[0]} {len(palette)} 2", *[f"{k} c #{r:02X}{g:02X}{b:02X}" for k, (r, g, b) in zip(key, palette, strict=True)], *["".join(key[i] for i in row) for row in index]]
    return ("/* XPM */\nstatic char *image[] = {\n" + ",\n".join(f'"{x}"' for x in lines) + "\n};\n").encode()


def xpm_decode(data: bytes) -> np.ndarray:
    lines = re.findall(r'"((?:[^"\\]|\\.)*)"', data.decode("latin-1"))
    w, h, n, size = (int(x) for x in lines[0].split()[:4])
    names = {"black": (0, 0, 0, 65535), "white": (65535, 65535, 65535, 65535), "none": (0, 0, 0, 0)}
    table = {}
    for line in lines[1 : n + 1]:
        color = re.search(r"\bc\s+(\S+)", line[size:])[1]
        if color.startswith("#"):
            d = len(color) // 3
            table[line[:size]] = (*[int(color[1 + k * d : 1 + (k + 1) * d], 16) * 65535 // (16**d - 1) for k in range(3)], 65535)
        else:
            table[line[:size]] = names[color.lower()]
    p = np.array([[table[row[k * size : (k + 1) * size]] for k in range(w)] for row in lines[n + 1 : n + 1 + h]], np.int32)
    return p if (p[:, :, 3] < 65535).any() else p[:, :, :3]


# --- depth and range ----------------------------------------------------------------------------------------------------------------


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def tiff_encode(p: np.ndarray, packed: bool = True) -> bytes:
    from . import tiff

    return tiff.encode([p], tiff.DEFLATE if packed else tiff.PLAIN)


def tiff_decode(data: bytes) -> np.ndarray:
    from . import tiff

    return tiff.decode(data)


def fits_encode(p: np.ndarray) -> bytes:
    """Three planes of unsigned 16 bits, rows from the bottom up."""
    h, w = p.shape[:2]
    cards = [("SIMPLE", "T"), ("BITPIX", "16"), ("NAXIS", "3"), ("NAXIS1", str(w)), ("NAXIS2", str(h)), ("NAXIS3", "3"), ("BZERO", "32768"), ("BSCALE", "1")]
    head = ("".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)).encode()
    body = (p[::-1, :, :3].transpose(2, 0, 1) - 32768).astype(">i2").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def fits_decode(data: bytes) -> np.ndarray:
    cards, at = {}, 0
    while True:
        card = data[at : at + 80].decode("latin-1")
        at += 80
        if card.startswith("END"):
            break
        if card[8:10] == "= ":
            cards[card[:8].strip()] = card[10:].split("/")[0].strip()
    at = -(-at // 2880) * 2880
    bits = int(cards["BITPIX"])
    w, h, n = int(cards["NAXIS1"]), int(cards["NAXIS2"]), int(cards.get("NAXIS3", 1))
    kind = {8: np.uint8, 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[bits]
    v = np.frombuffer(data, kind, w * h * n, at).astype(float) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    v = v.reshape(n, h, w)[:, ::-1].transpose(1, 2, 0)
    if bits == 8:
        v = v * 257
    elif bits not in (16,) or v.min() < 0:
        span = v.max() - v.min()
        v = (v - v.min()) / (span or 1) * 65535
    v = np.floor(np.clip(v, 0, 65535) + 0.5).astype(np.int32)
    return v.repeat(3, axis=2) if n == 1 else v[:, :, :3]


def hdr_encode(p: np.ndarray) -> bytes:
    """Radiance RGBE, flat pixels."""
    h, w = p.shape[:2]
    v = p[:, :, :3] / 65535.0
    top = v.max(axis=2)
    mantissa, exponent = np.frexp(top)
    scale = np.where(top > 1e-32, mantissa * 256 / np.maximum(top, 1e-38), 0)
    out = np.zeros((h, w, 4), np.uint8)
    out[:, :, :3] = np.clip(v * scale[:, :, None], 0, 255)
    out[:, :, 3] = np.where(top > 1e-32, exponent + 128, 0)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {h} +X {w}\n".encode() + out.tobytes()


def hdr_decode(data: bytes) -> np.ndarray:
    m = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", data)
    h, w, at = int(m[1]), int(m[2]), m.end()
    v = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if data[at : at + 2] == b"\2\2" and 8 <= w < 32768 and data[at + 2] << 8 | data[at + 3] == w:
            at += 4
            for c in range(4):
                row = bytearray()
                while len(row) < w:
                    n, at = data[at], at + 1
                    if n > 128:
                        row += data[at : at + 1] * (n - 128)
                        at += 1
                    else:
                        row += data[at : at + n]
                        at += n
                v[y, :, c] = np.frombuffer(bytes(row[:w]), np.uint8)
        else:
            v[y] = np.frombuffer(data, np.uint8, w * 4, at).reshape(w, 4)
            at += w * 4
    scale = np.where(v[:, :, 3] > 0, np.ldexp(1.0, v[:, :, 3].astype(int) - 136), 0)
    out = np.where(v[:, :, 3:] > 0, (v[:, :, :3] + 0.5) * scale[:, :, None], 0)
    return np.floor(np.clip(out, 0, 1) * 65535 + 0.5).astype(np.int32)


def ico_encode(p: np.ndarray) -> bytes:
    """One icon of 32 bits with its mask."""
    h, w = p.shape[:2]
    v = _bytes(_with_alpha(p))[::-1][:, :, [2, 1, 0, 3]]
    mask = bytes((w + 31) // 32 * 4 * h)
    body = struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, v.size, 0, 0, 0, 0) + v.tobytes() + mask
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 32, len(body), 22) + body


def ico_decode(data: bytes) -> np.ndarray:
    """The largest entry, of 24 or 32 bits or PNG."""
    from .codecs import png_decode

    entries = [struct.unpack_from("<BBBBHHII", data, 6 + 16 * k) for k in range(struct.unpack_from("<H", data, 4)[0])]
    best = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = data[best[7] : best[7] + best[6]]
    if body[:4] == b"\x89PNG":
        return png_decode(body)
    size, w, h, _, bits = struct.unpack_from("<IiiHH", body)
    h //= 2
    if bits not in (24, 32):
        raise ValueError("this kind of icon isn't read")
    line = (w * bits // 8 + 3) // 4 * 4
    v = np.frombuffer(body, np.uint8, line * h, size).reshape(h, line)[::-1, : w * bits // 8].reshape(h, w, bits // 8)
    return v[:, :, [2, 1, 0, 3][: bits // 8]].astype(np.int32) * 257


def dpx_encode(p: np.ndarray) -> bytes:
    """16 bits a channel, RGB, big-endian."""
    h, w = p.shape[:2]
    head = bytearray(2048)
    struct.pack_into(">II", head, 0, 0x53445058, 2048)
    head[8:16] = b"V1.0\0\0\0\0"
    struct.pack_into(">I", head, 16, 2048 + h * w * 6)
    struct.pack_into(">HHII", head, 768, 0, 1, w, h)
    head[800], head[803] = 50, 16
    struct.pack_into(">HHI", head, 804, 0, 0, 2048)
    return bytes(head) + p[:, :, :3].astype(">u2").tobytes()


def dpx_decode(data: bytes) -> np.ndarray:
    e = ">" if data[:4] == b"SDPX" else "<"
    start = struct.unpack_from(e + "I", data, 4)[0]
    w, h = struct.unpack_from(e + "II", data, 772)
    n, bits = {50: 3, 51: 4, 6: 1}[data[800]], data[803]
    if bits == 16:
        v = np.frombuffer(data, e + "u2", h * w * n, start).astype(np.int32)
    elif bits == 8:
        v = np.frombuffer(data, np.uint8, h * w * n, start).astype(np.int32) * 257
    elif bits == 10 and n == 3:
        words = np.frombuffer(data, e + "u4", h * w, start).astype(np.int64)
        v = np.stack([words >> s & 1023 for s in (22, 12, 2)], axis=1).astype(np.int32) * 65535 // 1023
    else:
        raise ValueError("this kind of DPX isn't read")
    v = v.reshape(h, w, n)
    return v.repeat(3, axis=2) if n == 1 else v


def tensor_encode(p: np.ndarray, channels_first: bool = True) -> bytes:
    """Little-endian header (magic, version, three sizes) and 32-bit floats in 0..1."""
    v = (p / 65535.0).astype("<f4")
    v = v.transpose(2, 0, 1) if channels_first else v
    return b"TENS" + struct.pack("<IIII", 1, *v.shape) + v.tobytes()


def tensor_decode(data: bytes) -> np.ndarray:
    shape = struct.unpack_from("<III", data, 8)
    v = np.frombuffer(data, "<f4", int(np.prod(shape)), 20).reshape(shape)
    v = v.transpose(1, 2, 0) if shape[0] in (3, 4) else v
    return np.floor(np.clip(v.astype(float), 0, 1) * 65535 + 0.5).astype(np.int32)


CODECS = {
    "wbmp": (wbmp_decode, wbmp_encode),
    "xbm": (xbm_decode, xbm_encode),
    "pcx": (pcx_decode, pcx_encode),
    "sgi": (sgi_decode, sgi_encode),
    "sun": (sun_decode, sun_encode),
    "pix": (pix_decode, pix_encode),
    "gif": (gif_decode, gif_encode),
    "xpm": (xpm_decode, xpm_encode),
    "tiff": (tiff_decode, tiff_encode),
    "fits": (fits_decode, fits_encode),
    "hdr": (hdr_decode, hdr_encode),
    "ico": (ico_decode, ico_encode),
    "dpx": (dpx_decode, dpx_encode),
    "tensor": (tensor_decode, tensor_encode),
}
