"""Inverse maps that are not affine: every output pixel takes a bilinear value at its source place, one numpy call an image."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.quantum import M
from .filters import _sample
from .kernels import SCHEMA, per_image


def _grid(w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    ys, xs = np.mgrid[0:h, 0:w].astype(float)
    return xs, ys


def _taken(p: np.ndarray, x: np.ndarray, y: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
    v = np.floor(np.round(_sample(p, np.where(np.isfinite(x), x, -1), np.where(np.isfinite(y), y, -1)), 6) + 0.5)
    return v if inside is None else np.where(inside[..., None], v, 0)


def _centred(p: np.ndarray, size: tuple[int, int], place: Callable) -> np.ndarray:
    """``place`` maps pixel centres; outside, edges are repeated."""
    xs, ys = _grid(*size)
    x, y = place(xs + 0.5, ys + 0.5)
    return _taken(p, x - 0.5, y - 0.5)


def rotate(df: DataFrame, degrees: float) -> DataFrame:
    """By any angle about the centre; the canvas grows to hold the image, black outside."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        corners = [(x * c - y * s, x * s + y * c) for x in (-w / 2, w / 2) for y in (-h / 2, h / 2)]
        nw, nh = (math.ceil(max(v[k] for v in corners) - min(v[k] for v in corners)) for k in (0, 1))
        xs, ys = _grid(nw, nh)
        dx, dy = xs - nw / 2, ys - nh / 2
        x, y = dx * c + dy * s + w / 2, -dx * s + dy * c + h / 2
        return _taken(p, x, y, (x >= 0) & (x < w - 1) & (y >= 0) & (y < h - 1))

    return per_image(df, f)


def homography(source: Sequence[float], target: Sequence[float]) -> np.ndarray:
    """The eight coefficients that send four source points (x, y, x, y, ...) to four target points."""
    rows, right = [], []
    for sx, sy, dx, dy in zip(source[::2], source[1::2], target[::2], target[1::2], strict=True):
        rows += [[sx, sy, 1, 0, 0, 0, -dx * sx, -dx * sy], [0, 0, 0, sx, sy, 1, -dy * sx, -dy * sy]]
        right += [dx, dy]
    return np.linalg.solve(np.array(rows, float), np.array(right, float))


def perspective(df: DataFrame, source: Sequence[float], target: Sequence[float], size: tuple[int, int]) -> DataFrame:
    """Four source points come to lie on four target points."""
    k = homography(target, source)

    def place(x, y):
        w = k[6] * x + k[7] * y + 1
        flat = np.abs(w) < 1e-12
        w = np.where(flat, 1, w)
        return np.where(flat, -1, (k[0] * x + k[1] * y + k[2]) / w), np.where(flat, -1, (k[3] * x + k[4] * y + k[5]) / w)

    return per_image(df, lambda p: _centred(p, size, place))


def to_polar(df: DataFrame) -> DataFrame:
    """x becomes the angle and y the radius about the centre."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        reach = math.hypot(w / 2, h / 2)
        return _centred(p, (w, h), lambda x, y: (w / 2 + y / h * reach * np.cos(x / w * 2 * math.pi), h / 2 + y / h * reach * np.sin(x / w * 2 * math.pi)))

    return per_image(df, f)


def from_polar(df: DataFrame) -> DataFrame:
    """The way back."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        reach = math.hypot(w / 2, h / 2)
        return _centred(p, (w, h), lambda x, y: (np.arctan2(y - h / 2, x - w / 2) % (2 * math.pi) / (2 * math.pi) * w, np.hypot(x - w / 2, y - h / 2) / reach * h))

    return per_image(df, f)


def spherize(df: DataFrame, amount: float = 1.0, cx: float = 0.5, cy: float = 0.5) -> DataFrame:
    """A lens of half the smaller side about a centre; black outside it."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        xs, ys = _grid(w, h)
        dx, dy, radius = xs - cx * w, ys - cy * h, min(w, h) * 0.5
        d, turn = np.hypot(dx, dy), np.arctan2(dy, dx)
        near = np.minimum(d / radius, 1)
        if amount == 0:
            far = d
        elif abs(amount) >= 0.999:
            far = near * near * amount * radius
        else:
            far = np.where(d < 0.001, d, radius * np.tan(np.arcsin(near * amount)) / math.tan(math.asin(amount)))
        return _taken(p, cx * w + np.cos(turn) * far, cy * h + np.sin(turn) * far, d < radius)

    return per_image(df, f)


def aberration_fix(df: DataFrame, red: float = 0.001, blue: float = -0.001) -> DataFrame:
    """Red and blue scaled about the centre."""

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        xs, ys = _grid(w, h)
        planes = [_taken(p[..., [k]], (xs - w / 2) * (1 + shift) + w / 2 - 0.5, (ys - h / 2) * (1 + shift) + h / 2 - 0.5) for k, shift in enumerate((red, 0.0, blue))]
        return np.concatenate(planes, axis=2)

    return per_image(df, f)


def displace(df: DataFrame, shifts: DataFrame, scale_x: float = 20.0, scale_y: float = 20.0) -> DataFrame:
    """Each pixel from a place that another image of the same id shifts: red along x, green along y, half is none."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("image_id", "y", "x", "r", "g", "b", "a")})
        h, w = int(left.y.max()) + 1, int(left.x.max()) + 1
        p, m = np.zeros((h, w, 3)), np.zeros((int(right.y.max()) + 1, int(right.x.max()) + 1, 2))
        p[left.y, left.x] = left[["r", "g", "b"]]
        m[right.y, right.x] = right[["r", "g"]]
        xs, ys = _grid(w, h)
        at = m[np.minimum(ys.astype(int), m.shape[0] - 1), np.minimum(xs.astype(int), m.shape[1] - 1)]
        half = M * 0.5
        v = _taken(p, xs + (at[..., 0] - half) / half * scale_x, ys + (at[..., 1] - half) / half * scale_y).astype(np.int32)
        return pd.DataFrame({"image_id": left.image_id.iloc[0], "y": ys.ravel().astype(np.int32), "x": xs.ravel().astype(np.int32), **{c: v[:, :, k].ravel() for k, c in enumerate("rgb")}, "a": pd.Series([None] * v[:, :, 0].size, dtype="Int32")})

    columns = ["image_id", "y", "x", "r", "g", "b"]
    return df.select(*columns).groupBy("image_id").cogroup(shifts.select(*columns).groupBy("image_id")).applyInPandas(run, SCHEMA)
