"""Cutting out objects: mixtures of colours with a minimum cut, soft mattes, saliency and background removal.

Every operator takes images as rows and a trimap or mask of the same id: white (above three quarters) is known foreground,
black (below a quarter) known background, all between is unknown. One image is in a task at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.quantum import M
from . import frames
from .attention import window_sums
from .stacks import LUMA

BACK, FRONT, MAYBE = 0, 1, 2
#: Weight of a boundary between like colours, and units of the cut's integer capacities.
SMOOTHNESS, UNITS = 50.0, 1 << 20
#: The four neighbours as (dy, dx), each followed by its opposite.
STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def known(trimap: np.ndarray) -> np.ndarray:
    v = trimap[..., 0].astype(np.int64)
    return np.where(v > M * 3 // 4, FRONT, np.where(v < M // 4, BACK, MAYBE))


def _shifted(v: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """What stands at (y + dy, x + dx)."""
    out = np.full_like(v, fill)
    h, w = v.shape[:2]
    out[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)] = v[max(dy, 0) : h - max(-dy, 0), max(dx, 0) : w - max(-dx, 0)]
    return out


class Mixture:
    """Gaussians of independent channels, fitted by assigning each colour to its most likely one, from even steps of luma."""

    def __init__(self, colors: np.ndarray, parts: int, rounds: int = 5):
        n = len(colors)
        self.k = max(1, min(parts, n))
        order = np.argsort(colors @ np.array([0.3, 0.59, 0.11]), kind="stable")
        self.mean = colors[order[np.arange(self.k) * n // self.k]] if n else np.zeros((1, 3))
        nearest = ((colors[:, None] - self.mean[None]) ** 2).sum(2).argmin(1) if n else np.zeros(0, int)
        for _ in range(rounds):
            self._learn(colors, nearest)
            nearest = self._logs(colors).argmax(1) if n else nearest

    def _learn(self, colors: np.ndarray, of: np.ndarray) -> None:
        count = np.bincount(of, minlength=self.k).astype(float)
        total = np.stack([np.bincount(of, colors[:, c], self.k) for c in range(3)], 1)
        squares = np.stack([np.bincount(of, colors[:, c] ** 2, self.k) for c in range(3)], 1)
        some = np.maximum(count, 1)[:, None]
        self.mean = total / some
        # a single colour, or equal ones, still has the spread of a few levels
        self.spread = np.maximum(squares / some - self.mean**2, 1e4)
        self.weight = count / max(count.sum(), 1)

    def _logs(self, colors: np.ndarray) -> np.ndarray:
        away = ((colors[:, None] - self.mean) ** 2 / self.spread).sum(2)
        with np.errstate(divide="ignore"):
            return np.log(self.weight) - 0.5 * (3 * np.log(2 * np.pi) + np.log(self.spread).sum(1) + away)

    def log_likelihood(self, colors: np.ndarray) -> np.ndarray:
        """Of the most likely part; a side without colours is unlikely everywhere."""
        return self._logs(colors).max(1) if self.weight.any() else np.full(len(colors), -1e6)


def boundary(colors: np.ndarray) -> list[np.ndarray]:
    """Costs of parting each pixel from its right and its lower neighbour: high between like colours, for the image's own contrast."""
    across, down = ((np.diff(colors, axis=a) ** 2).sum(2) for a in (1, 0))
    mean = (across.sum() + down.sum()) / max(across.size + down.size, 1)
    beta = 1 / (2 * mean) if mean > 1e-10 else 0.0
    return [SMOOTHNESS * np.exp(-beta * across), SMOOTHNESS * np.exp(-beta * down)]


def minimum_cut(source: np.ndarray, sink: np.ndarray, right: np.ndarray, below: np.ndarray) -> np.ndarray:
    """True where a pixel stays with the source in a minimum cut of a grid; integer capacities.

    ``source``, ``sink``: (h, w), paid where a pixel goes to the other side; ``right`` (h, w - 1) and ``below`` (h - 1, w):
    paid where two neighbours part. Push and relabel on all pixels at once: each step pushes along one direction, exact
    distances to the sink are taken again every few rounds, and what can't reach it is the source's side.
    """
    h, w = source.shape
    both = np.minimum(source, sink)
    excess, drain = (source - both).astype(np.int64), (sink - both).astype(np.int64)
    room = np.zeros((4, h, w), np.int64)
    room[3, :, :-1] = room[2, :, 1:] = right
    room[1, :-1] = room[0, 1:] = below
    far = h * w + 2

    def distances() -> np.ndarray:
        d = np.where(drain > 0, 1, far)
        while True:
            new = d.copy()
            for k, (dy, dx) in enumerate(STEPS):
                np.minimum(new, np.where(room[k] > 0, _shifted(d, dy, dx, far) + 1, far), out=new)
            if (new == d).all():
                return d
            d = new

    while True:
        d = distances()
        if not ((excess > 0) & (d < far)).any():
            return d >= far
        for _ in range(20):
            active = (excess > 0) & (d < far)
            if not active.any():
                break
            flow = np.where(active & (d == 1), np.minimum(excess, drain), 0)
            excess -= flow
            drain -= flow
            lowest = np.where(drain > 0, 1, far)
            for k, (dy, dx) in enumerate(STEPS):
                there = _shifted(d, dy, dx, far)
                flow = np.where((excess > 0) & (d < far) & (d == there + 1), np.minimum(excess, room[k]), 0)
                if flow.any():
                    excess -= flow
                    room[k] -= flow
                    back = _shifted(flow, -dy, -dx, 0)
                    excess += back
                    room[k ^ 1] += back
                lowest = np.minimum(lowest, np.where(room[k] > 0, there + 1, far))
            # pixels that still hold excess and have nowhere lower to send it rise
            d = np.where((excess > 0) & (d < lowest), np.minimum(lowest, far), d)


def cut_costs(p: np.ndarray, labels: np.ndarray, front: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """Capacities of one round: how unlikely each pixel's colour is on the other side, and the boundary."""
    colors = p[..., :3].astype(np.float64)
    flat = colors.reshape(-1, 3)
    logs = [Mixture(flat[side.reshape(-1)], parts).log_likelihood(flat).reshape(front.shape) for side in (front, ~front)]
    least = np.minimum(*logs)
    whole = lambda v: np.floor(np.minimum(v, 1e6) * UNITS).astype(np.int64)
    right, below = (whole(v) for v in boundary(colors))
    hard = int(right.sum() + below.sum() + (1 << 44))
    source = np.where(labels == FRONT, hard, np.where(labels == BACK, 0, whole(logs[0] - least)))
    sink = np.where(labels == BACK, hard, np.where(labels == FRONT, 0, whole(logs[1] - least)))
    return source, sink, right, below


def cut_out(p: np.ndarray, trimap: np.ndarray, rounds: int = 5, parts: int = 5) -> np.ndarray:
    """True in the foreground: mixtures learnt from the current sides, then the minimum cut of their costs, until nothing changes."""
    labels = known(trimap)
    front = labels != BACK
    for _ in range(rounds):
        new = minimum_cut(*cut_costs(p, labels, front, parts))
        if (new == front).all():
            break
        front = new
    return front


def _mask(v: np.ndarray) -> np.ndarray:
    return np.where(v, M, 0).astype("<u2")[..., None]


def grab_cut(images: DataFrame, trimaps: DataFrame, rounds: int = 5, parts: int = 5) -> DataFrame:
    """Masks of one channel, white where the foreground is. Without known foreground the unknown stands for it."""
    return frames.combine(images, trimaps, lambda p, t: _mask(cut_out(p, t, rounds, parts)))


# --- mattes -------------------------------------------------------------------------------------------------------------------------


def relative_matte(p: np.ndarray, trimap: np.ndarray, neighbours: int = 20, sigma: float = 10.0, block: int = 1 << 22) -> np.ndarray:
    """Unknown pixels by how far the nearest known colours of either side are: far from the background is opaque.

    The distance to a side is the mean over its ``neighbours`` nearest by colour and place, near ones weighing more.
    """
    labels = known(trimap)
    colors = p[..., :3].reshape(-1, 3).astype(np.float64) / M
    y, x = np.divmod(np.arange(labels.size), labels.shape[1])
    flat = labels.reshape(-1)
    unknown, sides = np.flatnonzero(flat == MAYBE), [np.flatnonzero(flat == s) for s in (FRONT, BACK)]
    k = max(1, min(neighbours, *map(len, sides)))
    alpha = np.where(flat == FRONT, 1.0, np.where(flat == BACK, 0.0, 0.5))

    def distance(of: np.ndarray, side: np.ndarray) -> np.ndarray:
        if not len(side):
            return np.ones(len(of))
        d = ((colors[of, None] - colors[side][None]) ** 2).sum(2) + ((x[of, None] - x[side]) ** 2 + (y[of, None] - y[side]) ** 2) / sigma**2 * 0.1
        d = np.partition(d, k - 1, axis=1)[:, :k]
        weight = np.exp(-d / (2 * sigma**2 + 1e-12))
        return (weight * d).sum(1) / weight.sum(1)

    step = max(1, block // max(1, *map(len, sides)))
    for a in range(0, len(unknown), step):
        of = unknown[a : a + step]
        front, back = (distance(of, s) for s in sides)
        total = front + back
        alpha[of] = np.where(total > 1e-12, back / np.where(total > 1e-12, total, 1), 0.5)
    return alpha.reshape(labels.shape)


def affinities(p: np.ndarray, neighbours: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixel, other, likeness): each pixel's most alike others of the window about it, by colour and a little by place."""
    h, w = p.shape[:2]
    v = p[..., :3].astype(np.float64) / M
    index = np.arange(h * w).reshape(h, w)
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    strip = max(1, (1 << 22) // (w * len(steps)))
    for top in range(0, h, strip):
        rows = np.arange(top, min(top + strip, h))
        far, other = np.full((len(steps), len(rows), w), np.inf), np.zeros((len(steps), len(rows), w), np.int64)
        for k, (dy, dx) in enumerate(steps):
            ys, xs = rows + dy, np.arange(w) + dx
            oky, okx = (ys >= 0) & (ys < h), (xs >= 0) & (xs < w)
            if oky.any() and okx.any():
                at = np.ix_(np.flatnonzero(oky), np.flatnonzero(okx))
                there = np.ix_(ys[oky], xs[okx])
                far[k][at] = ((v[rows][at] - v[there]) ** 2).sum(2) + 0.01 * (dy * dy + dx * dx) / (radius * radius)
                other[k][at] = index[there]
        k = min(neighbours, len(steps))
        best = np.argpartition(far, k - 1, axis=0)[:k]
        d, o = np.take_along_axis(far, best, 0), np.take_along_axis(other, best, 0)
        ok = np.isfinite(d)
        found.append((np.broadcast_to(index[rows], d.shape)[ok], o[ok], 1 - np.minimum(np.sqrt(d[ok] / 3), 1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def solved_matte(p: np.ndarray, trimap: np.ndarray, neighbours: int = 10, radius: int = 5, hold: float = 100.0, steps: int = 500, close: float = 1e-7) -> np.ndarray:
    """The matte that differs least between alike pixels and keeps what is known: (D - A + hold K) alpha = hold K known.

    The system is sparse and positive; conjugate gradients with its diagonal as preconditioner solve it without forming it.
    """
    labels = known(trimap)
    i, j, a = affinities(p, neighbours, radius)
    n = labels.size
    degree = np.bincount(i, a, n) + np.bincount(j, a, n)
    fixed = (labels.reshape(-1) != MAYBE) * hold
    diagonal = degree + fixed + 1e-9
    product = lambda v: diagonal * v - np.bincount(i, a * v[j], n) - np.bincount(j, a * v[i], n)
    target = fixed * (labels.reshape(-1) == FRONT) + 1e-9 * 0.5
    alpha = np.where(labels.reshape(-1) == FRONT, 1.0, np.where(labels.reshape(-1) == BACK, 0.0, 0.5))
    rest = target - product(alpha)
    z = rest / diagonal
    way, power = z, float(rest @ z)
    for _ in range(steps):
        if power <= close**2 * n:
            break
        q = product(way)
        move = power / float(way @ q)
        alpha = alpha + move * way
        rest = rest - move * q
        z = rest / diagonal
        power, before = float(rest @ z), power
        way = z + power / before * way
    return np.clip(alpha, 0, 1).reshape(labels.shape)


def alpha_matting(images: DataFrame, trimaps: DataFrame, neighbours: int = 20, sigma: float = 10.0) -> DataFrame:
    """Mattes of one channel by the distances to known colours of either side."""
    return frames.combine(images, trimaps, lambda p, t: (relative_matte(p, t, neighbours, sigma) * M)[..., None])


def knn_matting(images: DataFrame, trimaps: DataFrame, neighbours: int = 10, radius: int = 5) -> DataFrame:
    """Mattes of one channel by the sparse system of alike pixels."""
    return frames.combine(images, trimaps, lambda p, t: (solved_matte(p, t, neighbours, radius) * M)[..., None])


# --- saliency -----------------------------------------------------------------------------------------------------------------------


def saliency(p: np.ndarray, scales: tuple[int, ...] = (3, 7, 15, 31)) -> np.ndarray:
    """0 to 1: differences of luma from its means over windows of some sizes, smoothed by one of 11."""
    def mean(v: np.ndarray, radius: int) -> np.ndarray:
        total, n = window_sums(v, radius)
        return total / n

    luma = (p[..., :3].astype(np.float64) @ LUMA) / M
    v = sum(np.abs(luma - mean(luma, s // 2)) for s in scales)
    for smooth in (False, True):
        v = mean(v, 5) if smooth else v
        v = v / v.max() if v.max() > 0 else v
    return v


def saliency_map(images: DataFrame) -> DataFrame:
    return frames.apply(images, lambda p: (np.clip(saliency(p), 0, 1) * M)[..., None])


def without_background(p: np.ndarray, threshold: float = 0.4, margin: float = 0.15, rounds: int = 5) -> np.ndarray:
    """Saliency as a trimap, its cut as a softened mask, and that as alpha."""
    v = saliency(p)
    trimap = np.where(v >= threshold + margin, M, np.where(v <= threshold - margin, 0, M // 2))[..., None]
    mask = frames.blurred(_mask(cut_out(p, trimap, rounds)), 2.0)
    return np.concatenate([p[..., :3], np.floor(np.clip(mask, 0, M) + 0.5).astype("<u2")], axis=2)


def remove_background(images: DataFrame, threshold: float = 0.4, margin: float = 0.15, rounds: int = 5) -> DataFrame:
    return frames.apply(images, lambda p: without_background(p, threshold, margin, rounds))
