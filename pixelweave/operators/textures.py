"""Textures from images: seamless tiles, and synthesis that grows over an exemplar."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from ..functions.quantum import M
from ..sources.batches import follow
from . import frames


def seamless(p: np.ndarray, share: float = 0.25) -> np.ndarray:
    """Opposite edges faded into each other over a share of the sides, first left and right, then top and bottom."""
    share = min(max(share, 0.01), 0.5)
    v = p.astype(np.float64)
    for axis in (1, 0):
        n = int(p.shape[axis] * share)
        if not n:
            continue
        v = v.swapaxes(0, axis)
        t = (np.arange(n) * (1.0 / n))[:, None, None]
        first, last = v[:n].copy(), v[len(v) - n :].copy()
        v = v.copy()
        v[:n] = np.floor(np.clip(first * t + last * (1 - t), 0, M) + 0.5)
        v[len(v) - n :] = np.floor(np.clip(last * t + first * (1 - t), 0, M) + 0.5)
        v = v.swapaxes(0, axis)
    return v


def seamless_tile(images: DataFrame, share: float = 0.25) -> DataFrame:
    return frames.apply(images, lambda p: seamless(p, share))


def synthesized(p: np.ndarray, width: int, height: int, radius: int = 3, candidates: int | None = 200, seed: int = 42) -> np.ndarray:
    """A larger piece of the texture: a patch of it in the middle, then pixel by pixel outward, each from the most alike place.

    The surroundings of a new pixel, as far as they are filled, are compared with those of ``candidates`` random places of
    the exemplar (None: all), which repeats at its edges; the first of equally alike places counts.
    """
    rng = np.random.default_rng(seed)
    eh, ew, n = p.shape
    side = 2 * radius + 1
    wide = np.pad(p, ((radius, radius), (radius, radius), (0, 0)), mode="wrap").astype(np.float64)
    around = np.lib.stride_tricks.sliding_window_view(wide, (side, side), axis=(0, 1)).reshape(eh * ew, n, side * side)[:, :3].transpose(0, 2, 1)
    flat = p.reshape(eh * ew, n)
    out, done = np.zeros((height + 2 * radius, width + 2 * radius, n)), np.zeros((height + 2 * radius, width + 2 * radius), bool)
    sy, sx = int(rng.integers(eh)), int(rng.integers(ew))
    queue: deque[tuple[int, int]] = deque()

    def grow(y: int, x: int) -> None:
        queue.extend((y + dy, x + dx) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= y + dy < height and 0 <= x + dx < width and not done[y + dy + radius, x + dx + radius])

    start = [(y, x) for y in range(height // 2 - side // 2, height // 2 - side // 2 + side) for x in range(width // 2 - side // 2, width // 2 - side // 2 + side) if 0 <= y < height and 0 <= x < width]
    for y, x in start:
        out[y + radius, x + radius] = p[(sy + y - start[0][0]) % eh, (sx + x - start[0][1]) % ew]
        done[y + radius, x + radius] = True
    for y, x in start:
        grow(y, x)
    while queue:
        y, x = queue.popleft()
        if done[y + radius, x + radius]:
            continue
        have = done[y : y + side, x : x + side].reshape(-1)
        here = out[y : y + side, x : x + side, :3].reshape(side * side, -1)[have]
        of = np.arange(eh * ew) if candidates is None or candidates >= eh * ew else rng.integers(0, eh * ew, candidates)
        cost = ((around[np.ix_(of, np.flatnonzero(have))] - here) ** 2).sum((1, 2))
        out[y + radius, x + radius] = flat[of[int(cost.argmin())]]
        done[y + radius, x + radius] = True
        grow(y, x)
    return out[radius : radius + height, radius : radius + width]


def synthesize(images: DataFrame, width: int, height: int, radius: int = 3, candidates: int | None = 200, seed: int = 42) -> DataFrame:
    """Each image as an exemplar; the seed and the image_id fix what comes out, wherever it is computed."""
    def run(batches):
        for batch in batches:
            for row in zip(*[batch.column(c) for c in frames.COLUMNS], strict=True):
                key = row[0].as_py()
                yield frames._row(key, synthesized(frames._array(row), width, height, radius, candidates, [seed, key % (1 << 63)]))

    return follow(images, frames.COLUMNS, run, frames.SCHEMA)
