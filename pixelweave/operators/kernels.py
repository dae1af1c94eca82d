"""Sequential kernels: one image is one numpy call in a grouped task; images are spread over tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.quantum import M

SCHEMA = "image_id long, y int, x int, r int, g int, b int, a int"


def per_image(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``f`` to each image's (h, w, 3) array; alpha is kept where the size stays, else null.

    Pixels are gathered as arrays in the JVM and pass Arrow as one row an image; whole images go through ``frames.apply``.
    """
    from ..sources.codecs import to_pixels
    from . import frames

    def whole(p: np.ndarray) -> np.ndarray:
        out = np.clip(f(p[..., :3].astype(np.float64)), 0, M).astype("<u2")
        return np.concatenate([out, p[..., 3:]], axis=2) if out.shape[:2] == p.shape[:2] else out

    return to_pixels(frames.apply(frames.from_pixels(df), whole))


#: Error diffusion taps (dx, dy, share) of each method.
DIFFUSION = {
    "floydsteinberg": [(1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)],
    "atkinson": [(1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8)],
    "stucki": [(1, 0, 8 / 42), (2, 0, 4 / 42), (-2, 1, 2 / 42), (-1, 1, 4 / 42), (0, 1, 8 / 42), (1, 1, 4 / 42), (2, 1, 2 / 42), (-2, 2, 1 / 42), (-1, 2, 2 / 42), (0, 2, 4 / 42), (1, 2, 2 / 42), (2, 2, 1 / 42)],
    "sierra": [(1, 0, 5 / 32), (2, 0, 3 / 32), (-2, 1, 2 / 32), (-1, 1, 4 / 32), (0, 1, 5 / 32), (1, 1, 4 / 32), (2, 1, 2 / 32), (-1, 2, 2 / 32), (0, 2, 3 / 32), (1, 2, 2 / 32)],
}


def diffuse(pixels: np.ndarray, method: str = "floydsteinberg", levels: int = 2) -> np.ndarray:
    """Raster scan: each value goes to its nearest level, its error to later neighbours; colours of a pixel go together."""
    out, step = pixels / M, 1.0 / (max(levels, 2) - 1)
    h, w = out.shape[:2]
    for y in range(h):
        for x in range(w):
            old = np.clip(out[y, x], 0, 1)
            new = np.rint(old / step) * step
            error = old - new
            out[y, x] = new
            for dx, dy, share in DIFFUSION[method]:
                if 0 <= x + dx < w and y + dy < h:
                    out[y + dy, x + dx] += error * share
    return np.floor(out * M + 0.5)


def dither(df: DataFrame, method: str = "floydsteinberg", levels: int = 2) -> DataFrame:
    return per_image(df, lambda p: diffuse(p, method, levels))


def energy(pixels: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of a pixel's neighbours, edges repeated."""
    p = np.pad(pixels, ((1, 1), (1, 1), (0, 0)), mode="edge")
    return np.abs(p[1:-1, 2:] - p[1:-1, :-2]).sum(axis=2) + np.abs(p[2:, 1:-1] - p[:-2, 1:-1]).sum(axis=2)


def least_seam(cost: np.ndarray) -> np.ndarray:
    """Column of the vertical seam of least total cost in each row; ties to the left."""
    total = cost.copy()
    for y in range(1, len(cost)):
        above = np.pad(total[y - 1], 1, constant_values=np.inf)
        total[y] += np.minimum(np.minimum(above[:-2], above[1:-1]), above[2:])
    seam = np.empty(len(cost), int)
    seam[-1] = int(total[-1].argmin())
    for y in range(len(cost) - 2, -1, -1):
        low = max(0, seam[y + 1] - 1)
        seam[y] = low + int(total[y, low : seam[y + 1] + 2].argmin())
    return seam


def carve(pixels: np.ndarray, width: int) -> np.ndarray:
    """Remove or repeat least seams until the width fits."""
    while pixels.shape[1] > max(width, 1):
        seam = least_seam(energy(pixels))
        keep = np.arange(pixels.shape[1]) != seam[:, None]
        pixels = pixels[keep].reshape(len(pixels), -1, pixels.shape[2])
    if pixels.shape[1] < width:
        cost, seams = energy(pixels), []
        for _ in range(min(width - pixels.shape[1], pixels.shape[1])):
            seam = least_seam(cost)
            cost[np.arange(len(cost)), seam] += M * 6
            seams.append(seam)
        count = np.ones(pixels.shape[:2], int)
        for seam in seams:
            count[np.arange(len(count)), seam] += 1
        pixels = np.stack([np.repeat(row, n, axis=0) for row, n in zip(pixels, count, strict=True)])
        return carve(pixels, width) if pixels.shape[1] < width else pixels
    return pixels


def _energy_at(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``energy`` of a stack (n, h, w, c) at columns x (n, h, k) of each row."""
    n, h, w, _ = p.shape
    i, y = np.arange(n)[:, None, None], np.arange(h)[None, :, None]
    at = lambda yy, xx: p[i, np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.int32)
    return np.abs(at(y, x + 1) - at(y, x - 1)).sum(3) + np.abs(at(y + 1, x) - at(y - 1, x)).sum(3)


def carve_stack(stack: np.ndarray, width: int) -> np.ndarray:
    """``carve`` of narrower images of one size at once, (n, h, w, c): a seam of each is found and taken out in one pass over rows.

    Only the energy of the two columns on either side of a seam changes, so only that is computed again.
    """
    n, h, w, c = stack.shape
    cost = _energy_at(stack, np.broadcast_to(np.arange(w), (n, h, w))).astype(np.int64)
    i, rows = np.arange(n), np.arange(h)
    while stack.shape[2] > max(width, 1):
        w = stack.shape[2]
        total = np.full((h, n, w + 2), np.iinfo(np.int64).max // 2)
        total[0, :, 1:-1] = cost[:, 0]
        for y in range(1, h):
            above = total[y - 1]
            np.add(cost[:, y], np.minimum(np.minimum(above[:, :-2], above[:, 1:-1]), above[:, 2:]), out=total[y, :, 1:-1])
        seam = np.empty((n, h), np.int64)
        at = total[h - 1, :, 1:-1].argmin(1)
        seam[:, h - 1] = at
        for y in range(h - 2, -1, -1):
            # columns at - 1, at, at + 1 of the padded row; the first of equal ones
            line = total[y]
            left, middle, right = line[i, at], line[i, at + 1], line[i, at + 2]
            at = at + np.where((left <= middle) & (left <= right), -1, np.where(middle <= right, 0, 1))
            seam[:, y] = at
        keep = np.arange(w) != seam[..., None]
        stack = stack[keep].reshape(n, h, w - 1, c)
        cost = cost[keep].reshape(n, h, w - 1)
        if w - 1 > 0:
            near = np.clip(seam[..., None] + np.arange(-3, 3), 0, w - 2)
            cost[i[:, None, None], rows[None, :, None], near] = _energy_at(stack, near)
    return stack


def seam_carve(df: DataFrame, width: int, height: int) -> DataFrame:
    return per_image(df, lambda p: carve(carve(p, width).transpose(1, 0, 2), height).transpose(1, 0, 2))


def spectrum(df: DataFrame) -> DataFrame:
    """The magnitude spectrum of luma, zero-padded to powers of two, quadrants shifted, logarithmic, as a gray image."""

    def f(p: np.ndarray) -> np.ndarray:
        gray = p @ np.array([0.2126, 0.7152, 0.0722]) / M
        shape = [1 << max(0, (n - 1).bit_length()) for n in gray.shape]
        m = np.abs(np.fft.fftshift(np.fft.fft2(gray, shape)))
        v = np.log1p(m) / np.log1p(max(m.max(), 1e-12))
        return np.repeat(np.floor(v * M + 0.5)[:, :, None], 3, axis=2)

    return per_image(df, f)


def oil_paint(df: DataFrame, radius: int = 3, bins: int = 256) -> DataFrame:
    """The colour at which a luma bin first reaches the window's greatest count, in scan order."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        # summed from left to right: a matrix product may round a luma on a bin's edge the other way
        level = np.clip(((p[..., 0] * 0.2126 + p[..., 1] * 0.7152 + p[..., 2] * 0.0722) / M * (bins - 1) + 0.5).astype(int), 0, bins - 1)
        out = np.empty_like(p)
        for y in range(h):
            for x in range(w):
                counts, best, at = {}, 0, (y, x)
                for yy in range(max(0, y - radius), min(h, y + radius + 1)):
                    for xx in range(max(0, x - radius), min(w, x + radius + 1)):
                        n = counts[level[yy, xx]] = counts.get(level[yy, xx], 0) + 1
                        if n > best:
                            best, at = n, (yy, xx)
                out[y, x] = p[at]
        return out

    return per_image(df, f)


def palette(df: DataFrame, colors: int, sample: float = 0.25, rounds: int = 30, seed: int = 0) -> DataFrame:
    """image_id, idx, r, g, b, pct: k-means++ on a seeded sample of each image's pixels, largest share first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["y", "x"])[["r", "g", "b"]].to_numpy(float)
        rng = np.random.default_rng(seed)
        x = x[rng.random(len(x)) < sample] if len(x) > 256 and sample < 1 else x
        centers = x[[int(rng.integers(len(x)))]]
        while len(centers) < min(colors, len(x)):
            d = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
            if not d.sum():
                break
            centers = np.vstack((centers, x[rng.choice(len(x), p=d / d.sum())]))
        for _ in range(rounds):
            owner = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[owner == k].mean(0) if (owner == k).any() else centers[k] for k in range(len(centers))])
            if np.allclose(new, centers):
                break
            centers = new
        share = np.bincount(owner, minlength=len(centers)) / len(x)
        order = np.argsort(-share, kind="stable")
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "idx": np.arange(len(order)), "r": centers[order, 0], "g": centers[order, 1], "b": centers[order, 2], "pct": share[order]})

    return df.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInPandas(run, "image_id long, idx int, r double, g double, b double, pct double")
