"""Retouching: filling masked parts from their surroundings, stamps, and red eyes. A mask is white (not black) where to fill."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from ..functions.quantum import M
from . import frames
from .selection import _shifted


def _masked(mask: np.ndarray) -> np.ndarray:
    return mask[..., 0] > 0


def fill_from_edge(p: np.ndarray, hole: np.ndarray, radius: int = 5) -> np.ndarray:
    """A front runs inward from the edge of the hole: each pixel becomes the mean of what is known within the radius, near ones weighing more.

    Pixels stand in a queue by their distance from the edge, those of one distance in reading order of where they were
    found, and a filled pixel counts as known for the next.
    """
    h, w = hole.shape
    out, done = p.astype(np.int64), ~hole
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    square = dy * dy + dx * dx
    weights = np.where((square > 0) & (square <= radius * radius), 1 / np.maximum(square, 1), 0.0)
    edge = hole & np.logical_or.reduce([_shifted(done, a, b, False) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    far = np.where(edge, 1, np.iinfo(np.int64).max)
    queue = deque(zip(*(v.tolist() for v in np.nonzero(edge)), strict=True))
    while queue:
        y, x = queue.popleft()
        if done[y, x]:
            continue
        top, left = max(y - radius, 0), max(x - radius, 0)
        near = (slice(top, y + radius + 1), slice(left, x + radius + 1))
        k = weights[top - y + radius :, left - x + radius :][: out[near].shape[0], : out[near].shape[1]] * done[near]
        total = k.sum()
        if total > 0:
            out[y, x] = np.clip(np.round((out[near] * k[..., None]).sum((0, 1)) / total, 9) + 0.5, 0, M).astype(np.int64)
        done[y, x] = True
        for ny in range(max(y - 1, 0), min(y + 2, h)):
            for nx in range(max(x - 1, 0), min(x + 2, w)):
                if not done[ny, nx] and far[ny, nx] > far[y, x] + 1:
                    far[ny, nx] = far[y, x] + 1
                    queue.append((ny, nx))
    return out


def fill_along_edges(p: np.ndarray, hole: np.ndarray, radius: int = 5, rounds: int = 20) -> np.ndarray:
    """From that fill on, diffusion inside the hole that slows down across edges; the border of the image stays."""
    v = fill_from_edge(p, hole, radius)
    inside = hole[1:-1, 1:-1, None]
    for _ in range(rounds):
        n, s, e, w, c = v[:-2, 1:-1], v[2:, 1:-1], v[1:-1, 2:], v[1:-1, :-2], v[1:-1, 1:-1]
        slope = np.sqrt(((e - w) * 0.5) ** 2 + ((s - n) * 0.5) ** 2)
        step = 0.25 * (n + s + e + w - 4.0 * c) * np.where(slope > 0.001, 1 / (1 + slope), 1.0)
        new = np.clip(c + step + 0.5, 0, M).astype(np.int64)
        v = v.copy()
        v[1:-1, 1:-1] = np.where(inside, new, c)
    return v


#: Pairs of places that are compared at once.
COMPARED = 1 << 16


class PatchField:
    """Of each masked pixel the place in the known part whose patch is most like its own, improved in turns.

    All masked pixels are improved at once: a neighbour's place, moved along, is tried for each direction, then random
    places about the best one at halving distances. The image is filled anew after each turn, so patches fill up inward.
    """

    def __init__(self, p: np.ndarray, hole: np.ndarray, size: int, seed: int):
        self.p, self.hole, self.half = p[..., :3].astype(np.float32), hole, size // 2
        self.flat = self.p.reshape(-1, 3)
        reach = np.arange(-self.half, self.half + 1)
        #: (dy, dx) of a patch's places, row by row, as columns
        self.around = np.repeat(reach, len(reach))[:, None], np.tile(reach, len(reach))[:, None]
        h, w = hole.shape
        ok = np.zeros(hole.shape, bool)
        ok[self.half : h - self.half, self.half : w - self.half] = True
        self.allowed = ok & ~hole
        self.y, self.x = np.nonzero(hole)
        self.rng = np.random.default_rng(seed)
        self.number = np.full(hole.shape, -1)
        self.number[self.y, self.x] = np.arange(len(self.y))
        places = np.argwhere(self.allowed)
        self.ok = bool(len(places)) and bool(len(self.y))
        if self.ok:
            self.at = places[self.rng.integers(0, len(places), len(self.y))]

    def cost(self, now: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Mean squared difference of the patches about masked pixels ``of`` and places ``at``, inside the image."""
        h, w = self.hole.shape
        dy, dx = self.around
        mean = np.empty(len(of))
        step = max(1, COMPARED // dy.size)
        for a in range(0, len(of), step):
            some, place = of[a : a + step], at[a : a + step]
            sy, sx = self.y[some] + dy, self.x[some] + dx
            ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
            d = now.reshape(-1, 3).take(np.where(ok, sy * w + sx, 0), 0) - self.flat.take((place[:, 0] + dy) * w + place[:, 1] + dx, 0)
            square = np.where(ok, (d * d).sum(2), 0)
            total = np.zeros(len(some))
            for one in square:  # in the order of the places, whatever their number
                total += one
            mean[a : a + step] = total / np.maximum(ok.sum(0), 1)
        return mean

    def turn(self, now: np.ndarray) -> None:
        everyone = np.arange(len(self.y))
        best = self.cost(now, self.at, everyone)
        h, w = self.hole.shape

        def offer(at: np.ndarray, of: np.ndarray) -> None:
            ok = (at[:, 0] >= 0) & (at[:, 0] < h) & (at[:, 1] >= 0) & (at[:, 1] < w)
            ok[ok] = self.allowed[at[ok, 0], at[ok, 1]]
            at, of = at[ok], of[ok]
            if len(of):
                cost = self.cost(now, at, of)
                less = cost < best[of]
                self.at[of[less]], best[of[less]] = at[less], cost[less]

        for dy, dx in ((0, -1), (-1, 0), (0, 1), (1, 0)):
            ny, nx = self.y + dy, self.x + dx
            ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
            other = np.where(ok, self.number[np.where(ok, ny, 0), np.where(ok, nx, 0)], -1)
            of = np.flatnonzero(other >= 0)
            offer(self.at[other[of]] - (dy, dx), of)
        reach = max(h, w)
        while reach > 1:
            offer(self.at + self.rng.integers(-reach, reach + 1, self.at.shape), everyone)
            reach //= 2

    def filled(self, p: np.ndarray) -> np.ndarray:
        out = p.copy()
        out[self.y, self.x] = p[self.at[:, 0], self.at[:, 1]]
        return out


def fill_with_patches(p: np.ndarray, hole: np.ndarray, size: int = 9, rounds: int = 5, seed: int = 42) -> np.ndarray:
    """Each masked pixel from the known part, from the most alike patch found; as it is where no whole patch is known."""
    field = PatchField(p, hole, size, seed)
    if not field.ok:
        return p
    now = fill_from_edge(p, hole)
    for _ in range(rounds):
        field.turn(now[..., :3].astype(np.float32))
        now = field.filled(p)
    return now


def inpaint(images: DataFrame, masks: DataFrame, radius: int = 5) -> DataFrame:
    return frames.combine(images, masks, lambda p, m: fill_from_edge(p, _masked(m), radius))


def inpaint_edges(images: DataFrame, masks: DataFrame, radius: int = 5, rounds: int = 20) -> DataFrame:
    return frames.combine(images, masks, lambda p, m: fill_along_edges(p, _masked(m), radius, rounds))


def patch_fill(images: DataFrame, masks: DataFrame, size: int = 9, rounds: int = 5, seed: int = 42) -> DataFrame:
    return frames.combine(images, masks, lambda p, m: fill_with_patches(p, _masked(m), size, rounds, seed))


def remove_object(images: DataFrame, masks: DataFrame, size: int = 9, feather: float = 3.0, seed: int = 42) -> DataFrame:
    """Patches where the mask is, mixed with the image by a softened mask."""

    def f(p: np.ndarray, m: np.ndarray) -> np.ndarray:
        new = fill_with_patches(p, _masked(m), size, seed=seed)
        share = np.clip(np.maximum(frames.blurred(np.where(_masked(m), M, 0)[..., None], feather) / M, _masked(m)[..., None]), 0, 1)
        return np.floor(p * (1 - share) + new * share + 0.5)

    return frames.combine(images, masks, f)


# --- stamps -------------------------------------------------------------------------------------------------------------------------


def _stamp(shape: tuple[int, ...], sx: int, sy: int, dx: int, dy: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns (from 0 in the stamp) that lie inside the image at both ends."""
    h, w = shape[:2]
    inside = lambda n, size, a, b: np.array([k for k in range(max(n, 0)) if 0 <= a + k < size and 0 <= b + k < size], int)
    return inside(min(height, h - sy, h - dy), h, sy, dy), inside(min(width, w - sx, w - dx), w, sx, dx)


def clone_stamp(images: DataFrame, sx: int, sy: int, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """A rectangle copied to another place, cut at the bounds of the image."""

    def f(p: np.ndarray) -> np.ndarray:
        ys, xs = _stamp(p.shape, sx, sy, dx, dy, width, height)
        out = p.copy()
        out[np.ix_(ys + dy, xs + dx)] = p[np.ix_(ys + sy, xs + sx)]
        return out

    return frames.apply(images, f)


def healed(p: np.ndarray, sx: int, sy: int, dx: int, dy: int, width: int, height: int) -> np.ndarray:
    h, w = p.shape[:2]
    ys, xs = _stamp(p.shape, sx, sy, dx, dy, width, height)
    out = p.copy()
    out[np.ix_(ys + dy, xs + dx)] = p[np.ix_(ys + sy, xs + sx)]
    sw, sh = min(width, w - sx, w - dx), min(height, h - sy, h - dy)
    if sw <= 2 or sh <= 2:
        return out

    def border(x: int, y: int) -> np.ndarray:
        """Mean colour of the rectangle's outline, as far as it lies in the image."""
        yy, xx = np.mgrid[0:sh, 0:sw]
        ok = ((yy == 0) | (yy == sh - 1) | (xx == 0) | (xx == sw - 1)) & (yy + y >= 0) & (yy + y < h) & (xx + x >= 0) & (xx + x < w)
        return p[(yy + y)[ok], (xx + x)[ok]].astype(np.float64).mean(0) if ok.any() else np.zeros(p.shape[2])

    offset = (border(dx, dy) - border(sx, sy))[:3]
    share = lambda n: np.minimum(np.minimum(np.arange(n), n - 1 - np.arange(n)) / max(n // 2, 1), 1.0)
    weight = share(sh)[:, None] * share(sw)[None]
    iy, ix = (np.flatnonzero((np.arange(n) + d >= 0) & (np.arange(n) + d < size)) for n, d, size in ((sh, dy, h), (sw, dx, w)))
    at = np.ix_(iy + dy, ix + dx)
    out = out.astype(np.int64)
    part = out[at]
    part[..., :3] = np.clip(part[..., :3] + offset * weight[np.ix_(iy, ix)][..., None] + 0.5, 0, M).astype(np.int64)
    out[at] = part
    return out


def healing_brush(images: DataFrame, sx: int, sy: int, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """A stamp whose tone is shifted towards its new surroundings, most in the middle."""
    return frames.apply(images, lambda p: healed(p, sx, sy, dx, dy, width, height))


def red_eye(images: DataFrame, x: int, y: int, radius: int, threshold: float = 0.6) -> DataFrame:
    """Red inside a circle towards luma, by how far its redness exceeds the threshold."""

    def f(p: np.ndarray) -> np.ndarray:
        yy, xx = np.mgrid[0 : p.shape[0], 0 : p.shape[1]]
        r, g, b = (p[..., c].astype(np.float64) / M for c in range(3))
        redness = np.where(g + b > 0.001, r / np.maximum((g + b) * 0.5 + r, 1e-300), 0)
        share = np.clip((redness - threshold) / (1 - threshold), 0, 1)
        new = np.clip((r * (1 - share) + (0.299 * r + 0.587 * g + 0.114 * b) * share) * M + 0.5, 0, M).astype(np.int64)
        out = p.astype(np.int64)
        out[..., 0] = np.where(((yy - y) ** 2 + (xx - x) ** 2 <= radius * radius) & (redness > threshold), new, p[..., 0])
        return out

    return frames.apply(images, f)
