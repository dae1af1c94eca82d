"""Creative filters on whole images as rows: crystals, halftone screens, speckles, sparse colours, pushes and straightening."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.quantum import M
from ..sources.batches import follow
from . import frames

#: Multipliers of the lattice hash that jitters crystals: odd, larger than any image, the same in any language.
LATTICE = (73856093, 19349663, 83492791)


def jitter(gx: np.ndarray, gy: np.ndarray, k: int, size: int) -> np.ndarray:
    """0 to size - 1 for each cell of a grid, by an exclusive-or of its place and ``k`` times fixed odd numbers."""
    return ((gx * LATTICE[0] ^ gy * LATTICE[1] ^ k * LATTICE[2]) & 0x7FFFFFFF) % size


def crystals(p: np.ndarray, size: int = 16, seed: int = 42) -> np.ndarray:
    """Cells about jittered points of a grid, in their mean colour (rounded down); a pixel is of the nearest of nine, the first of equal ones."""
    h, w = p.shape[:2]
    columns, rows = max(1, w // size), max(1, h // size)
    gy, gx = np.mgrid[0:rows, 0:columns]
    cx = np.clip(gx * size + jitter(gx, gy, 2 * seed, size), 0, w - 1)
    cy = np.clip(gy * size + jitter(gx, gy, 2 * seed + 1, size), 0, h - 1)
    y, x = np.mgrid[0:h, 0:w]
    best, cell = np.full((h, w), np.iinfo(np.int64).max), np.zeros((h, w), np.int64)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            ny, nx = np.clip(y // size, 0, rows - 1) + dy, np.clip(x // size, 0, columns - 1) + dx
            ok = (ny >= 0) & (ny < rows) & (nx >= 0) & (nx < columns)
            ny, nx = np.clip(ny, 0, rows - 1), np.clip(nx, 0, columns - 1)
            d = np.where(ok, (x - cx[ny, nx]) ** 2 + (y - cy[ny, nx]) ** 2, best)
            less = d < best
            best, cell = np.where(less, d, best), np.where(less, ny * columns + nx, cell)
    flat, n = cell.reshape(-1), rows * columns
    count = np.maximum(np.bincount(flat, minlength=n), 1)
    means = np.stack([np.bincount(flat, p[..., c].reshape(-1), n).astype(np.int64) // count for c in range(p.shape[2])], 1)
    return means[cell]


def crystallize(images: DataFrame, size: int = 16, seed: int = 42) -> DataFrame:
    if size < 2:
        raise ValueError("cells of at least two pixels")
    return frames.apply(images, lambda p: crystals(p, size, seed))


def _screen(ink: np.ndarray, dot: float, degrees: float) -> np.ndarray:
    """Dots of a turned grid, each as large as the ink at its middle."""
    h, w = ink.shape
    y, x = np.mgrid[0:h, 0:w].astype(float)
    c, s = math.cos(degrees * math.pi / 180), math.sin(degrees * math.pi / 180)
    rx, ry = x * c + y * s, -x * s + y * c
    mx, my = np.floor(rx / dot + 0.5) * dot, np.floor(ry / dot + 0.5) * dot
    at = ink[np.clip((mx * s + my * c).astype(int), 0, h - 1), np.clip((mx * c - my * s).astype(int), 0, w - 1)]
    return np.where((rx - mx) ** 2 + (ry - my) ** 2 <= at * (dot * 0.5) ** 2, at, 0.0)


def halftone(images: DataFrame, dot: int = 6, degrees: Sequence[float] = (15.0, 75.0, 0.0, 45.0)) -> DataFrame:
    """Cyan, magenta, yellow and black screens, each at its own angle."""
    if dot < 2:
        raise ValueError("dots of at least two pixels")

    def f(p: np.ndarray) -> np.ndarray:
        v = p[..., :3].astype(np.float64) / M
        k = 1.0 - v.max(2)
        share = np.where(k < 1, 1 / np.where(k < 1, 1 - k, 1), 0)
        inks = [_screen((1.0 - v[..., c] - k) * share, dot, degrees[c]) for c in range(3)]
        black = _screen(k, dot, degrees[3])
        out = np.stack([(1 - ink) * (1 - black) * M for ink in inks], 2)
        return np.concatenate([np.floor(out + 0.5), p[..., 3:]], 2)

    return frames.apply(images, f)


#: One level of eight bits; the directions of the hulls as (dy, dx).
STEP, HULLS = 257, ((0, 1), (1, 0), (1, 1), (-1, 1))


def despeckled(v: np.ndarray) -> np.ndarray:
    """One channel: pixels two levels darker than the neighbour of a direction rise by one, then brighter ones fall, four directions, both ways, twice.

    The edge is repeated once around the image; the frame's sides take part, its corners and outer rows stay.
    """
    wide = np.pad(v.astype(np.int64), 1, mode="edge")
    width, flat = wide.shape[1], wide.reshape(-1)
    inside = np.arange(width + 1, flat.size - width - 1)
    for dy, dx in HULLS:
        offset = dy * width + dx
        for way, up in ((offset, True), (offset, True), (-offset, True), (-offset, True), (-offset, False), (-offset, False), (offset, False), (offset, False)):
            own, other = flat[inside], flat[inside + way]
            new = np.where(other >= own + 2 * STEP, np.minimum(own + STEP, M), own) if up else np.where(other <= own - 2 * STEP, np.maximum(own - STEP, 0), own)
            flat = flat.copy()
            flat[inside] = new
    return flat.reshape(wide.shape)[1:-1, 1:-1]


def despeckle(images: DataFrame) -> DataFrame:
    return frames.apply(images, lambda p: np.stack([despeckled(p[..., c]) for c in range(p.shape[2])], 2))


def sparse_color(images: DataFrame, method: str, points: Sequence[tuple[float, float, float, float, float]]) -> DataFrame:
    """Colours of a few points (x, y, r, g, b) spread over each image: ``voronoi``, ``manhattan``, ``shepards`` or ``inverse``.

    The first two take the nearest point's, the first of equal ones; the others the mean weighed by one over the squared or
    plain distance, at most 1. Alpha stays.
    """
    if not points or method not in ("voronoi", "manhattan", "shepards", "inverse"):
        raise ValueError("at least one point and a known method are needed")
    at, colors = np.array(points, float)[:, :2], np.array(points, float)[:, 2:]

    def f(p: np.ndarray) -> np.ndarray:
        y, x = np.mgrid[0 : p.shape[0], 0 : p.shape[1]]
        dx, dy = x[..., None] - at[:, 0], y[..., None] - at[:, 1]
        if method in ("voronoi", "manhattan"):
            d = dx * dx + dy * dy if method == "voronoi" else np.abs(dx) + np.abs(dy)
            color = colors[d.argmin(2)]
        else:
            d = (dx * dx + dy * dy) ** (1.0 if method == "shepards" else 0.5)
            weight = 1 / np.maximum(d, 1.0)
            color = (weight @ colors) / weight.sum(2, keepdims=True)
        return np.concatenate([np.floor(np.clip(color + 0.5, 0, M)), p[..., 3:]], 2)

    return frames.apply(images, f)


def pushed(p: np.ndarray, cx: int, cy: int, radius: int, strength: float, dx: float, dy: float) -> np.ndarray:
    """A soft push inside a circle: each pixel is read from where it came, between four neighbours, rounded down."""
    h, w = p.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    d = (x - cx) ** 2 + (y - cy) ** 2
    weight = np.exp(-d / (2.0 * (radius / 3.0) ** 2)) * strength
    sx, sy = x - dx * weight, y - dy * weight
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    x1, y1 = np.clip(np.minimum(x0 + 1, w - 1), 0, None), np.clip(np.minimum(y0 + 1, h - 1), 0, None)
    x0, y0 = np.clip(x0, 0, w - 1), np.clip(y0, 0, h - 1)
    v = p[y0, x0] * (1 - fx) * (1 - fy) + p[y0, x1] * fx * (1 - fy) + p[y1, x0] * (1 - fx) * fy + p[y1, x1] * fx * fy
    return np.where((d < radius * radius)[..., None], np.floor(np.round(v, 6)), p).astype(np.int64)


def liquify(images: DataFrame, pushes: Sequence[tuple[int, int, float, float]], radius: int, strength: float) -> DataFrame:
    """Pushes (x, y, dx, dy) one after another."""

    def f(p: np.ndarray) -> np.ndarray:
        for cx, cy, dx, dy in pushes:
            p = pushed(p, cx, cy, radius, strength, dx, dy)
        return p

    return frames.apply(images, f)


def angles() -> list[float]:
    """From -10 to 10 degrees in tenths, added up one by one."""
    out, a = [], -10.0
    while a <= 10.0:
        out.append(a)
        a += 0.1
    return out


def skew(p: np.ndarray, threshold: float = 0.4) -> float:
    """The angle at which the dark pixels, projected, bunch most: lines of text fall into few bins. 0 without dark pixels."""
    h, w = p.shape[:2]
    y, x = np.nonzero(p[..., :3].astype(np.float64).sum(2) / 3.0 < int(threshold * M))
    best, found = 0.0, 0.0
    bins = h + w
    for angle in angles():
        a = angle * math.pi / 180.0
        at = ((x - w / 2.0) * math.sin(a) + (y - h / 2.0) * math.cos(a) + bins // 2).astype(int)
        n = np.bincount(at[(at >= 0) & (at < bins)], minlength=bins).astype(float)
        spread = float((n * n).sum() / bins - (len(x) / bins) ** 2) if len(x) else 0.0
        if spread > best + 1e-12:
            best, found = spread, angle
    return found


def skews(images: DataFrame, threshold: float = 0.4) -> DataFrame:
    """image_id, degrees of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[batch.column(c) for c in frames.COLUMNS], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([skew(frames._array(r), threshold) for r in rows], pa.float64())], names=["image_id", "degrees"])

    return follow(images, frames.COLUMNS, run, "image_id long, degrees double")


def turned(p: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle on a canvas that holds all of it, between four neighbours, black outside."""
    h, w = p.shape[:2]
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    nw, nh = math.ceil(abs(w * c) + abs(h * s) - 1e-9), math.ceil(abs(w * s) + abs(h * c) - 1e-9)
    y, x = np.mgrid[0:nh, 0:nw].astype(float)
    dx, dy = x - nw / 2, y - nh / 2
    sx, sy = dx * c + dy * s + w / 2, -dx * s + dy * c + h / 2
    inside = (sx >= 0) & (sx < w - 1) & (sy >= 0) & (sy < h - 1)
    x0, y0 = np.where(inside, sx, 0).astype(int), np.where(inside, sy, 0).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    v = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return np.where(inside[..., None], np.floor(v + 0.5), 0)


def deskew(images: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Each image turned so that its lines of dark pixels lie level; one askew by less than a hundredth of a degree stays."""

    def f(p: np.ndarray) -> np.ndarray:
        angle = skew(p, threshold)
        return p if abs(angle) < 0.01 else turned(p, angle)

    return frames.apply(images, f)


def sheared(p: np.ndarray, tangent: float) -> np.ndarray:
    """Rows moved along x by ``tangent`` times their distance from the middle row, between two pixels; black beside them."""
    h, w, n = p.shape
    grow = math.ceil(abs(tangent) * h)
    out = np.zeros((h, w + grow + 1, n))
    if n == 4:
        out[..., 3] = M
    for y in range(h):
        moved = tangent * (y - h / 2.0)
        step = math.floor(moved)
        part, at = moved - step, grow // 2 + step
        line = np.zeros((w + grow + 1, n))
        if n == 4:
            line[:, 3] = M
        for x in range(w):
            k = x + at
            if not 0 <= k < w + grow:
                continue
            if k + 1 >= w + grow:
                line[k] = p[y, x]
                continue
            line[k] = np.floor(line[k] * part + p[y, x] * (1 - part))
            line[k + 1] = np.floor(line[k + 1] * (1 - part) + p[y, x] * part)
        out[y] = line
    return out[:, : w + grow]


def shear(images: DataFrame, x_degrees: float, y_degrees: float) -> DataFrame:
    """Along x, then along y."""

    def f(p: np.ndarray) -> np.ndarray:
        wide = sheared(p, math.tan(x_degrees * math.pi / 180.0))
        return sheared(wide.transpose(1, 0, 2), math.tan(y_degrees * math.pi / 180.0)).transpose(1, 0, 2)

    return frames.apply(images, f)


def polaroid(images: DataFrame, border: int = 20, color: tuple[int, int, int] = (M, M, M)) -> DataFrame:
    """A frame of one colour, three times as wide below."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w, n = p.shape
        out = np.empty((h + 4 * border, w + 2 * border, n))
        out[...] = [*color, M][:n]
        out[border : border + h, border : border + w] = p
        return out

    return frames.apply(images, f)
