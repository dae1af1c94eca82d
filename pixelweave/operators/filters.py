"""Filters whose windows depend on the pixels: one numpy call an image, images spread over tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantum import M
from .kernels import per_image

LUMA = np.array([0.2126, 0.7152, 0.0722])


def _shifted(p: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Each pixel's neighbour at an offset, edges repeated."""
    h, w = p.shape[:2]
    return p[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


def _sample(p: np.ndarray, x: np.ndarray, y: np.ndarray, clamp: bool = True) -> np.ndarray:
    """Bilinear values at real places; outside: the edge, or black."""
    h, w = p.shape[:2]
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    v = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return v if clamp else np.where(inside[..., None], v, 0)


def gaussian(p: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, math.ceil(3 * sigma))
    w = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    w /= w.sum()
    for axis in (0, 1):
        p = sum(k * _shifted(p, *((d, 0) if axis else (0, d))) for d, k in zip(range(-radius, radius + 1), w, strict=True))
    return p


def bilateral_pixels(p: np.ndarray, radius: int, spatial: float, tonal: float) -> np.ndarray:
    total, weight = np.zeros(p.shape), np.zeros(p.shape)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            n = _shifted(p, dx, dy)
            bucket = np.floor(np.abs(n - p) / 257)
            k = math.exp(-(dx * dx + dy * dy) / (2 * spatial * spatial)) * np.exp(-((bucket / 255) ** 2) / (2 * tonal * tonal))
            total += n * k
            weight += k
    return np.round(total / weight, 6)


def bilateral(df: DataFrame, radius: int = 2, spatial: float = 1.5, tonal: float = 0.1) -> DataFrame:
    """[t] Neighbours weigh by distance and by likeness of each channel."""
    return per_image(df, lambda p: bilateral_pixels(p, radius, spatial, tonal))


def selective_blur(df: DataFrame, sigma: float = 1.0, threshold: float = 0.1) -> DataFrame:
    """Gaussian mean of the neighbours within a contrast."""
    radius = max(1, math.ceil(3 * sigma))

    def f(p: np.ndarray) -> np.ndarray:
        total, weight = np.zeros(p.shape), np.zeros(p.shape)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                n = _shifted(p, dx, dy)
                k = math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) * (np.abs(n - p).max(axis=2, keepdims=True) <= threshold * M)
                total += n * k
                weight += k
        return np.floor(total / weight + 0.5)

    return per_image(df, f)


def kuwahara_pixels(p: np.ndarray, radius: int) -> np.ndarray:
    light = p @ LUMA
    best, out = np.full(light.shape, np.inf), p.copy()
    for sy in (-1, 1):
        for sx in (-1, 1):
            offsets = [(sx * a, sy * b) for b in range(radius + 1) for a in range(radius + 1)]
            near = np.stack([_shifted(light, *o) for o in offsets])
            spread = ((near - near.mean(axis=0)) ** 2).sum(axis=0)
            mean = sum(_shifted(p, *o) for o in offsets) / len(offsets)
            take = spread < best
            best, out = np.where(take, spread, best), np.where(take[..., None], mean, out)
    return out


def kuwahara(df: DataFrame, radius: int = 2) -> DataFrame:
    """[t] The mean of the quadrant whose luma varies least; the first wins."""
    return per_image(df, lambda p: kuwahara_pixels(p, radius))


def _mean_of_places(p: np.ndarray, places: list[tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The weighted mean of the nearest pixels at real places (weight, x, y); places outside don't count."""
    h, w = p.shape[:2]
    total, weight = np.zeros(p.shape), np.zeros((h, w, 1))
    for k, x, y in places:
        sx, sy = np.rint(x).astype(int), np.rint(y).astype(int)
        inside = ((sx >= 0) & (sx < w) & (sy >= 0) & (sy < h))[..., None]
        total += np.where(inside, p[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)] * k, 0)
        weight += np.where(inside, k, 0)
    return np.where(weight > 0, np.floor(total / np.maximum(weight, 1e-300) + 0.5), p)


def motion_blur(df: DataFrame, radius: int, sigma: float, degrees: float) -> DataFrame:
    """A Gaussian along a direction, centred; what lies outside the image doesn't count."""
    dx, dy = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def f(p: np.ndarray) -> np.ndarray:
        ys, xs = np.mgrid[0 : p.shape[0], 0 : p.shape[1]]
        return _mean_of_places(p, [(math.exp(-n * n / (2 * sigma * sigma)), xs + n * dx, ys + n * dy) for n in range(-radius, radius + 1)])

    return per_image(df, f)


def radial_blur(df: DataFrame, degrees: float) -> DataFrame:
    """The mean over turns about (w / 2, h / 2); their number grows with the angle and the root of the half diagonal."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        dy, dx = (v - c for v, c in zip(np.mgrid[0:h, 0:w], (h / 2, w / 2), strict=True))
        steps = max(3, int(2 * degrees * math.sqrt(math.hypot(w / 2, h / 2))) + 1) | 1
        turns = (np.arange(steps) - steps // 2) * (math.radians(degrees) / (steps - 1))
        return _mean_of_places(p, [(1.0, dx * math.cos(t) - dy * math.sin(t) + w / 2, dx * math.sin(t) + dy * math.cos(t) + h / 2) for t in turns])

    return per_image(df, f)


def wavelet_denoise(df: DataFrame, threshold: float, levels: int = 3) -> DataFrame:
    """À-trous levels with soft thresholds that halve from level to level."""

    def f(p: np.ndarray) -> np.ndarray:
        now, detail = p.astype(float), 0
        for k in range(levels):
            step = 1 << k
            soft = now
            for axis in (0, 1):
                at = lambda d, s=soft, axis=axis, step=step: _shifted(s, *((d * step, 0) if axis else (0, d * step)))
                soft = (at(-2) + 4 * at(-1) + 6 * at(0) + 4 * at(1) + at(2)) / 16
            rough = now - soft
            limit = threshold * M / 2**k
            detail = detail + np.sign(rough) * np.maximum(np.abs(rough) - limit, 0)
            now = soft
        return np.floor(now + detail + 0.5)

    return per_image(df, f)


def clahe_pixels(p: np.ndarray, tiles_x: int, tiles_y: int, clip: float) -> np.ndarray:
    h, w = p.shape[:2]
    light = p @ LUMA
    level = np.clip(np.floor(light / M * 255 + 0.5), 0, 255).astype(int)
    tiles_x, tiles_y = max(2, min(tiles_x, w)), max(2, min(tiles_y, h))
    xs, ys = (np.linspace(0, n, t + 1).astype(int) for n, t in ((w, tiles_x), (h, tiles_y)))
    maps = np.zeros((tiles_y, tiles_x, 256))
    for j in range(tiles_y):
        for i in range(tiles_x):
            part = level[ys[j] : ys[j + 1], xs[i] : xs[i + 1]]
            counts = np.bincount(part.reshape(-1), minlength=256)
            limit = max(1, int(clip * part.size / 256))
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over // 256
            maps[j, i] = np.cumsum(counts) / max(counts.sum(), 1)
    fy = np.clip((np.arange(h) + 0.5) * tiles_y / h - 0.5, 0, tiles_y - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles_x / w - 0.5, 0, tiles_x - 1)
    j0, i0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    j1, i1 = np.minimum(j0 + 1, tiles_y - 1), np.minimum(i0 + 1, tiles_x - 1)
    ty, tx = (fy - j0)[:, None], (fx - i0)[None]
    at = lambda j, i: maps[j[:, None], i[None], level]
    new = (at(j0, i0) * (1 - tx) + at(j0, i1) * tx) * (1 - ty) + (at(j1, i0) * (1 - tx) + at(j1, i1) * tx) * ty
    gain = np.where(light > 0, new * M / np.maximum(light, 1e-9), 0)
    return np.floor(np.clip(p * gain[..., None], 0, M) + 0.5)


def clahe(df: DataFrame, tiles_x: int = 8, tiles_y: int = 8, clip: float = 2.0) -> DataFrame:
    """Equalisation by tile with clipped histograms, blended between tiles; colours keep their ratio to luma."""
    return per_image(df, lambda p: clahe_pixels(p, tiles_x, tiles_y, clip))


def canny_pixels(p: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    light = gaussian((p @ LUMA / M)[..., None], sigma)[..., 0]
    at = lambda dx, dy: _shifted(light, dx, dy)
    gx = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    gy = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    size = np.hypot(gx, gy)
    turn = np.round(np.arctan2(gy, gx) / (math.pi / 4)).astype(int) % 4
    padded = np.pad(size, 1)
    h, w = size.shape
    near = lambda dx, dy: padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    peak = np.zeros(size.shape, bool)
    for k, (dx, dy) in enumerate(((1, 0), (1, 1), (0, 1), (-1, 1))):
        peak |= (turn == k) & (size >= near(dx, dy)) & (size >= near(-dx, -dy))
    weak, strong = peak & (size >= low), peak & (size >= high)
    while True:
        grown = np.pad(strong, 1)
        touch = np.zeros(size.shape, bool)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                touch |= grown[dy : dy + h, dx : dx + w]
        new = weak & touch
        if (new == strong).all():
            break
        strong = new | strong
    return np.repeat(np.where(strong, M, 0)[..., None], 3, axis=2)


def canny(df: DataFrame, sigma: float = 1.0, low: float = 0.1, high: float = 0.3) -> DataFrame:
    """Blur, gradient, thinning along the gradient, and weak edges that touch strong ones."""
    return per_image(df, lambda p: canny_pixels(p, sigma, low, high))


def mean_shift(df: DataFrame, radius: int = 3, color: float = 0.1, rounds: int = 5) -> DataFrame:
    """Each pixel moves to the mean of the near pixels of like colour, a few times."""

    def f(p: np.ndarray) -> np.ndarray:
        now = p.astype(float)
        for _ in range(rounds):
            total, weight = np.zeros(p.shape), np.zeros((*p.shape[:2], 1))
            for dy in range(-radius, radius + 1):
                for dx in range(-radius, radius + 1):
                    n = _shifted(now, dx, dy)
                    k = ((n - now) ** 2).sum(axis=2, keepdims=True) <= 3 * (color * M) ** 2
                    total += n * k
                    weight += k
            new = total / weight
            if np.abs(new - now).max() < 1:
                break
            now = new
        return np.floor(now + 0.5)

    return per_image(df, f)


def vignette(df: DataFrame, sigma: float = 10.0, inset_x: int | None = None, inset_y: int | None = None) -> DataFrame:
    """The image, over black, times a blurred white ellipse that lies a tenth of the size inside the edges; opaque."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        ix, iy = int(w * 0.1) if inset_x is None else inset_x, int(h * 0.1) if inset_y is None else inset_y
        ys, xs = np.mgrid[0:h, 0:w]
        inside = ((xs - w / 2) / max(1.0, w / 2 - ix)) ** 2 + ((ys - h / 2) / max(1.0, h / 2 - iy)) ** 2 <= 1
        mask = np.floor(gaussian(np.where(inside, float(M), 0.0)[..., None], sigma if sigma > 0 else 10.0) + 0.5)
        return np.floor(p * (mask / M) + 0.5)

    share = F.coalesce(F.col("a"), F.lit(M)) / M
    flat = df.select("image_id", "y", "x", *[F.floor(F.col(c) * share + 0.5).cast("int").alias(c) for c in "rgb"], F.lit(None).cast("int").alias("a"))
    return per_image(flat, f)


def implode(df: DataFrame, amount: float = 0.5) -> DataFrame:
    """Radial pinch (positive) or punch about (w / 2, h / 2), inside the largest circle in units of the width."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        ys, xs = np.mgrid[0:h, 0:w].astype(float)
        dx, dy = xs - w / 2, (ys - h / 2) * (w / h)
        radius, d = min(w, h) / 2, np.hypot(dx, dy)
        near = (d < radius) & (d > 0)
        k = np.where(near, np.sin(math.pi / 2 * np.where(near, d, radius) / radius) ** -amount, 1.0)
        inside = d < radius
        return np.where(inside[..., None], np.floor(np.round(_sample(p, np.where(inside, k * dx + w / 2, 0), np.where(inside, k * dy / (w / h) + h / 2, 0)), 6) + 0.5), p)

    return per_image(df, f)


def wave(df: DataFrame, amplitude: float, length: float) -> DataFrame:
    """Columns shifted by a sine; the canvas grows by twice the amplitude; black above the first and from the last row on."""
    grow = math.ceil(abs(amplitude))

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        ys, xs = np.mgrid[0 : h + 2 * grow, 0:w].astype(float)
        at = ys - (grow + amplitude * np.sin(2 * math.pi * xs / length))
        return np.where(((at >= 0) & (at < h - 1))[..., None], np.floor(_sample(p, xs, at) + 0.5), 0)

    return per_image(df, f)


def glow(df: DataFrame, threshold: float = 0.5, sigma: float = 2.0, intensity: float = 0.6) -> DataFrame:
    """The blurred bright parts (integer luma) screened over the image."""

    def f(p: np.ndarray) -> np.ndarray:
        v = p.astype(np.int64)
        light = (77 * v[..., 0] + 150 * v[..., 1] + 29 * v[..., 2]) >> 8
        soft = gaussian(np.where((light >= threshold * M)[..., None], p, 0).astype(float), sigma) * intensity
        return np.floor(np.round(M - (M - p) * (M - np.minimum(soft, M)) / M, 6) + 0.5)

    return per_image(df, f)


def dehaze(df: DataFrame, strength: float = 0.5, radius: int = 7) -> DataFrame:
    """[t] Dark channel, airlight of its top thousandth, transmission at least 0.1."""

    def f(p: np.ndarray) -> np.ndarray:
        dark = np.min([_shifted(p.min(axis=2), dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)], axis=0)
        order = np.argsort(-dark.reshape(-1), kind="stable")[: max(1, dark.size // 1000)]
        air = np.maximum(p.reshape(-1, 3)[order].mean(axis=0), 1)
        near = (p / air).min(axis=2)
        dark = np.min([_shifted(near, dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)], axis=0)
        t = np.maximum(1 - strength * dark, 0.1)[..., None]
        return np.clip((p - air) / t + air, 0, M)

    return per_image(df, f)


#: Weights of the 25 neighbours of ``enhance``.
NEAR = [[5, 8, 10, 8, 5], [8, 20, 40, 20, 8], [10, 40, 80, 40, 10], [8, 20, 40, 20, 8], [5, 8, 10, 8, 5]]


def enhance(df: DataFrame) -> DataFrame:
    """[t] A weighted mean of near values that are alike, each channel alone; edges repeated."""

    def f(p: np.ndarray) -> np.ndarray:
        total, weight = np.zeros(p.shape), np.zeros(p.shape)
        for j, row in enumerate(NEAR):
            for i, w in enumerate(row):
                n = _shifted(p, i - 2, j - 2)
                k = w / 25 * np.maximum(0, 1 - np.abs(n - p) / M * 3)
                total += n * k
                weight += k
        return np.floor(np.round(total / weight, 6))

    return per_image(df, f)
