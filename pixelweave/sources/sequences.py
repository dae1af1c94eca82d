"""Files of several images: animations as whole canvases, one at a time, and their writers."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np

from . import more_codecs, tiff, webp
from .codecs import _chunk, codec, png_decode, png_encode

PNG = b"\x89PNG\r\n\x1a\n"


def composed(frames: Iterable[dict], width: int, height: int) -> Iterator[tuple[np.ndarray, dict]]:
    """The canvas after each frame: frames have pixels (h, w, 4), x, y, dispose and blend; what lies outside the canvas is cut."""
    canvas = np.zeros((height, width, 4), np.int32)
    for f in frames:
        x, y = f["x"], f["y"]
        before = canvas.copy() if f["dispose"] == "previous" else None
        window = canvas[max(y, 0) : y + f["pixels"].shape[0], max(x, 0) : x + f["pixels"].shape[1]]
        part = f["pixels"][max(-y, 0) :, max(-x, 0) :][: window.shape[0], : window.shape[1]]
        if f["blend"]:
            share = part[:, :, 3:] / 65535
            rest = window[:, :, 3:] / 65535 * (1 - share)
            total = share + rest
            color = (part[:, :, :3] * share + window[:, :, :3] * rest) / np.where(total > 0, total, 1)
            part = np.floor(np.concatenate([color, total * 65535], axis=2) + 0.5).astype(np.int32)
        window[...] = part
        yield canvas.copy(), f
        if f["dispose"] == "background":
            window[...] = 0
        elif before is not None:
            canvas = before


def apng_frames(data: bytes) -> Iterator[dict]:
    """Frames of an animated PNG as they stand in the file; a still one is its image."""
    at, head, shared, body, control, animated = 8, b"", b"", b"", None, False

    def frame() -> dict:
        w, h, x, y, over, under, dispose, blend = struct.unpack(">IIIIHHBB", control)
        p = png_decode(PNG + _chunk(b"IHDR", struct.pack(">II", w, h) + head[8:]) + shared + _chunk(b"IDAT", body) + _chunk(b"IEND", b""))
        p = p if p.shape[2] == 4 else np.concatenate([p, np.full((*p.shape[:2], 1), 65535, p.dtype)], axis=2)
        return {"pixels": p, "x": x, "y": y, "delay": over * 1000 // (under or 100), "dispose": ("none", "background", "previous")[dispose], "blend": bool(blend)}

    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = part
        elif kind == b"acTL":
            animated = True
        elif kind == b"fcTL":
            if body and control:
                yield frame()
            # image data before the first control chunk is no frame of the animation
            control, body = part[4:], b""
        elif kind == b"IDAT":
            if control or not animated:
                body += part
        elif kind == b"fdAT":
            body += part[4:]
        elif kind in (b"PLTE", b"tRNS"):
            shared += _chunk(kind, part)
    if not control:
        w, h = struct.unpack_from(">II", head)
        control = struct.pack(">IIIIHHBB", w, h, 0, 0, 0, 100, 0, 0)
    if body:
        yield frame()


def apng_encode(images: list[np.ndarray], delays: list[int] | None = None, loops: int = 0) -> bytes:
    """Frames of one size and number of channels, each replacing the one before; delays in milliseconds."""
    h, w = images[0].shape[:2]
    out, number = b"", 0
    for k, p in enumerate(images):
        one = png_encode(p)
        out += _chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, w, h, 0, 0, (delays or [100] * len(images))[k], 1000, 0, 0))
        number += 1
        at = 8
        while at < len(one):
            size, kind = struct.unpack_from(">I4s", one, at)
            part = one[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR" and k == 0:
                out = PNG + _chunk(b"IHDR", part) + _chunk(b"acTL", struct.pack(">II", len(images), loops)) + out
            elif kind == b"IDAT" and k == 0:
                out += _chunk(kind, part)
            elif kind == b"IDAT":
                out += _chunk(b"fdAT", struct.pack(">I", number) + part)
                number += 1
    return out + _chunk(b"IEND", b"")


def _gif_frames(data: bytes) -> Iterator[dict]:
    for f in more_codecs.gif_each_frame(data):
        yield f | {"delay": f["delay"] * 10, "blend": True}


def images(kind: str, file: BinaryIO, pixels: bool = True, parts: bool = False, share: tuple[int, int] = (0, 1)) -> Iterator[dict]:
    """frame, x, y, width, height, channels, delay and data (an array; None without ``pixels``) of each image of a file.

    Animations give whole canvases, TIFF files their pages (with ``parts`` their strips or tiles), all others one image.
    ``share`` (k, n) takes every n-th page from k on; only TIFF files can be shared.
    """
    row = lambda n, p, delay=0, x=0, y=0: {"frame": n, "x": x, "y": y, "width": p.shape[1], "height": p.shape[0], "channels": p.shape[2], "delay": delay, "data": p if pixels else None}
    if kind == "tiff":
        for n, page in enumerate(tiff.pages(file)):
            if n % share[1] != share[0]:
                continue
            if not pixels and not parts:
                yield {"frame": n, "x": 0, "y": 0, "width": page.width, "height": page.height, "channels": page.channels, "delay": 0, "data": None}
            elif parts:
                for x, y, v in page.parts():
                    yield row(n, v, x=x, y=y)
            else:
                yield row(n, page.image())
        return
    data = file.read()
    if kind == "gif":
        found, size = _gif_frames(data), struct.unpack_from("<HH", data, 6)
    elif kind == "png" and b"acTL" in data[:4096]:
        found, size = apng_frames(data), struct.unpack_from(">II", data, 16)
    elif kind == "webp" and webp.canvas_size(data):
        found, size = webp.frames(data), webp.canvas_size(data)
    else:
        yield row(0, codec(kind)[0](data))
        return
    for n, (canvas, f) in enumerate(composed(found, *size)):
        yield row(n, canvas, f["delay"])


#: Writers of several images in one file: (arrays, delays in milliseconds) → bytes.
WRITERS = {
    "gif": lambda images, delays: more_codecs.gif_encode_sequence(images, [d // 10 for d in delays]),
    "png": apng_encode,
    "webp": webp.encode_sequence,
    "tiff": lambda images, delays: tiff.encode(images),
    "tiff_tiled": lambda images, delays: tiff.encode(images, tiff.LZW, tile=16),
    "tiff_fax": lambda images, delays: tiff.encode(images, tiff.GROUP4),
}
