"""Summed-area tables, and what they serve on whole images: local thresholds, interest maps and crops to what matters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.quantum import M
from ..sources.batches import follow
from . import frames


def summed(v: np.ndarray) -> np.ndarray:
    """Sums of all values above and to the left, by two running sums; a row and a column of zeros first."""
    out = np.zeros((v.shape[0] + 1, v.shape[1] + 1, *v.shape[2:]), np.int64 if v.dtype.kind in "uib" else np.float64)
    np.cumsum(v, axis=0, out=out[1:, 1:], dtype=out.dtype)
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def window_sums(v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, numbers of places) of the square window about each place, cut at the bounds of the image: four reads a place."""
    h, w = v.shape[:2]
    s = summed(v)
    top, bottom = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius, h - 1) + 1
    left, right = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius, w - 1) + 1
    total = s[bottom][:, right] - s[top][:, right] - s[bottom][:, left] + s[top][:, left]
    return total, (bottom - top)[:, None] * (right - left)[None]


def adaptive_threshold(images: DataFrame, window: int = 3, offset: float = 0.0) -> DataFrame:
    """Each channel white where it reaches its own window's integer mean less the offset, black elsewhere; an even window grows by one."""
    radius, less = (window + 1 - window % 2) // 2, int(abs(offset) * M)

    def f(p: np.ndarray) -> np.ndarray:
        total, n = window_sums(p, radius)
        return np.where(p >= np.maximum(total // n[..., None] - less, 0), M, 0).astype("<u2")

    return frames.apply(images, f)


def gray_bytes(p: np.ndarray) -> np.ndarray:
    v = p[..., :3].astype(np.float64) / M * 255
    return (0.299 * v[..., 0] + 0.587 * v[..., 1] + 0.114 * v[..., 2]).astype(np.int64)


def edges(gray: np.ndarray) -> np.ndarray:
    """Sobel magnitudes; 0 on the border."""
    out = np.zeros(gray.shape)
    if min(gray.shape) > 2:
        at = lambda dy, dx: gray[1 + dy : gray.shape[0] - 1 + dy, 1 + dx : gray.shape[1] - 1 + dx]
        gx = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + at(1, 1) - at(1, -1)
        gy = at(1, -1) - at(-1, -1) + 2 * (at(1, 0) - at(-1, 0)) + at(1, 1) - at(-1, 1)
        out[1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy)
    return out


def entropy(gray: np.ndarray, block: int = 16) -> np.ndarray:
    """Bits of entropy of the levels in the window about each place; one window sum for each level that occurs."""
    out = np.zeros(gray.shape)
    for level in np.unique(gray):
        count, n = window_sums(gray == level, block // 2)
        share = count / n
        out -= np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0)
    return out


#: Levels of a channel in the coarse histogram of colours, and the share of the largest bin from which colours are common.
BINS, COMMON = 6, 0.1


def rarity(p: np.ndarray) -> np.ndarray:
    """ln(1 + pixels / count) of colours below the common bins of a coarse histogram; 0 for common ones."""
    level = np.minimum((p[..., :3].astype(np.float64) / M * 255).astype(np.int64) // (256 // BINS), BINS - 1)
    bin_ = (level[..., 0] * BINS + level[..., 1]) * BINS + level[..., 2]
    counts = np.bincount(bin_.reshape(-1), minlength=BINS**3)
    rare = (counts > 0) & (counts < counts.max() * COMMON)
    return np.where(rare, np.log(1 + bin_.size / np.maximum(counts, 1)), 0.0)[bin_]


def interest(p: np.ndarray) -> np.ndarray:
    gray = gray_bytes(p)
    return rarity(p) * 2 + entropy(gray) + np.log(1 + edges(gray)) * 0.1


def foreground(p: np.ndarray, threshold: float = 0.15) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of what differs from the mean colour of the corners; the whole image if nothing wide and high does."""
    h, w = p.shape[:2]
    n = max(1, min(w, h) // 10)
    v = p[..., :3].astype(np.int64)
    corner = np.concatenate([c.reshape(-1, 3) for c in (v[:n, :n], v[:n, w - n :], v[h - n :, :n], v[h - n :, w - n :])])
    # distances times the corners' pixels are whole numbers: one that is the threshold is not above it
    away = (np.abs(v * len(corner) - corner.sum(0)) > round(threshold * M * len(corner), 6)).any(2)
    ys, xs = np.flatnonzero(away.any(1)), np.flatnonzero(away.any(0))
    if not len(ys) or xs[0] >= xs[-1] or ys[0] >= ys[-1]:
        return 0, 0, w, h
    return int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1


def best_region(p: np.ndarray, width: int, height: int) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the window of most interest, weighed down towards the bottom of the foreground.

    A coarse grid over the foreground, then every place about its best; the first of equal ones in reading order. Each
    window is four reads of a summed-area table.
    """
    h, w = p.shape[:2]
    width, height = min(width, w), min(height, h)
    left, top, right, bottom = foreground(p)
    fw, fh = right - left, bottom - top
    table = summed(interest(p))
    x = min(max((left + right) // 2 - width // 2 if fw <= width else left, 0), w - width)
    y = min(max(top if fh <= height else top + int(fh * 0.1), 0), h - height)
    best = -np.inf
    step = max(2, min(fw, fh) // 50)

    def search(ys: np.ndarray, xs: np.ndarray) -> None:
        nonlocal x, y, best
        if not len(ys) or not len(xs):
            return
        total = table[ys + height][:, xs + width] - table[ys][:, xs + width] - table[ys + height][:, xs] + table[ys][:, xs]
        score = total * (1.0 - 0.6 * ((ys - top) / max(1, fh)))[:, None]
        k = int(score.argmax())
        if score.flat[k] > best:
            best, y, x = float(score.flat[k]), int(ys[k // len(xs)]), int(xs[k % len(xs)])

    search(np.arange(max(0, top - height // 4), min(h - height, bottom - height // 4) + 1, step), np.arange(max(0, left - width // 4), min(w - width, right - width // 2) + 1, step))
    search(np.arange(max(0, y - 2 * step), min(h - height, y + 2 * step) + 1), np.arange(max(0, x - 2 * step), min(w - width, x + 2 * step) + 1))
    return x, y, width, height


def regions(images: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, x, y, width, height of each image's best region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row[0].as_py(), *best_region(frames._array(row), width, height)) for row in zip(*[batch.column(c) for c in frames.COLUMNS], strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if k else pa.int64()) for k, c in enumerate(columns)], names=["image_id", "x", "y", "width", "height"])

    return follow(images, frames.COLUMNS, run, "image_id long, x int, y int, width int, height int")


def smart_crop(images: DataFrame, width: int, height: int) -> DataFrame:
    def f(p: np.ndarray) -> np.ndarray:
        if width >= p.shape[1] and height >= p.shape[0]:
            return p
        x, y, w, h = best_region(p, width, height)
        return np.ascontiguousarray(p[y : y + h, x : x + w])

    return frames.apply(images, f)


def interest_map(images: DataFrame) -> DataFrame:
    """Entropy and edges, each over its largest value, as heat: black, blue, green, yellow, red."""

    def f(p: np.ndarray) -> np.ndarray:
        gray = gray_bytes(p)
        parts = [v / (v.max() if v.max() >= 1e-6 else 1.0) for v in (entropy(gray), edges(gray))]
        t = np.minimum(1.0, parts[0] * 0.67 + parts[1] * 0.33)
        s = [(t - a) / 0.25 * M for a in (0.0, 0.25, 0.5, 0.75)]
        zero, full = np.zeros_like(t), np.full_like(t, M)
        pieces = [t < 0.25, t < 0.5, t < 0.75]
        red = np.select(pieces, [zero, zero, s[2]], full)
        green = np.select(pieces, [zero, s[1], full], M - s[3])
        blue = np.select(pieces, [s[0], M - s[1], zero], zero)
        return np.stack([red, green, blue], 2)

    return frames.apply(images, f)
