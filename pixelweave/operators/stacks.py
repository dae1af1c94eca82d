"""Stacks of aligned images: exposures merged or fused, and focal planes joined.

The images of a stack (seq_id) meet in one task in order of z and are folded one by one: what a task holds is one image and
a few accumulators, however many images a stack has. No pixel is a row, and nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantum import M
from ..sources.batches import follow
from . import frames
from .attention import window_sums

#: Rec. 709 luma.
LUMA = np.array([0.2126, 0.7152, 0.0722])


class Fold(Protocol):
    def add(self, p: np.ndarray, z: int, value: float | None) -> None: ...

    def result(self) -> np.ndarray: ...


def fold(images: DataFrame, start: Callable[[], Fold], value: str | None = None) -> DataFrame:
    """One image for each seq_id (its image_id): its images, sorted by z, go one after another into a new ``start()``.

    ``images``: seq_id, z and the columns of frames; ``value`` names a number that goes with each image. Images of one
    stack have one size; others are an error. Images of equal z stand by image_id.
    """
    names = ["seq_id", "z", "value", *frames.COLUMNS]
    rows = images.select(F.col("seq_id").cast("long"), F.col("z").cast("int"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"), *frames.COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, shape = None, None, None
        for batch in batches:
            for row in zip(*[batch.column(c) for c in names], strict=True):
                seq = row[0].as_py()
                if state is None or seq != key:
                    if state is not None:
                        yield frames._row(key, state.result())
                    key, state, shape = seq, start(), None
                p = frames._array(row[3:])
                if shape is not None and p.shape[:2] != shape[:2]:
                    raise ValueError(f"images of stack {seq} have different sizes")
                shape = p.shape
                state.add(p, row[1].as_py(), row[2].as_py())
        if state is not None:
            yield frames._row(key, state.result())

    dealt = rows.repartition("seq_id").sortWithinPartitions("seq_id", "z", "image_id")
    return follow(dealt, dealt.columns, run, frames.SCHEMA)


class _Merge:
    """Radiance as a mean of what each exposure shows, weighed by a triangle about middle luma."""

    def __init__(self):
        self.total, self.weight, self.alpha = 0.0, 0.0, None

    def add(self, p: np.ndarray, z: int, value: float | None) -> None:
        v = p[..., :3].astype(np.float64)
        luma = (v[..., 0] * LUMA[0] + v[..., 1] * LUMA[1] + v[..., 2] * LUMA[2]) / M
        weight = np.where(luma <= 0.5, 2 * luma, 2 * (1 - luma))[..., None]
        self.total = self.total + weight * (v / M / 2.0 ** (value or 0.0))
        self.weight = self.weight + weight
        if self.alpha is None:
            self.alpha = p[..., 3:].copy()

    def result(self) -> np.ndarray:
        radiance = np.where(self.weight > 0, self.total / np.where(self.weight > 0, self.weight, 1), 0)
        top = radiance.max()
        out = radiance * (M / top if top > 0 else 1.0)
        return np.concatenate([np.clip(out, 0, M).astype("<u2"), self.alpha], axis=2)


def hdr_merge(images: DataFrame, exposure: str) -> DataFrame:
    """Exposures of one scene as radiance, the brightest at the top of the range; ``exposure``: a column of stops."""
    return fold(images, _Merge, exposure)


def quality(p: np.ndarray, contrast: float, saturation: float, exposedness: float) -> np.ndarray:
    """Contrast (Laplacian of luma inside the border), saturation (spread of the channels) and closeness to the middle, multiplied."""
    v = p[..., :3].astype(np.float64) / M
    r, g, b = v[..., 0], v[..., 1], v[..., 2]
    exposed = np.exp(-12.5 * (r - 0.5) * (r - 0.5)) * np.exp(-12.5 * (g - 0.5) * (g - 0.5)) * np.exp(-12.5 * (b - 0.5) * (b - 0.5))
    mean = (r + g + b) / 3.0
    spread = np.sqrt(((r - mean) * (r - mean) + (g - mean) * (g - mean) + (b - mean) * (b - mean)) / 3.0)
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    edge = np.zeros_like(luma)
    edge[1:-1, 1:-1] = np.abs(4 * luma[1:-1, 1:-1] - luma[:-2, 1:-1] - luma[2:, 1:-1] - luma[1:-1, :-2] - luma[1:-1, 2:])
    return (edge + 1e-10) ** contrast * (spread + 1e-10) ** saturation * exposed**exposedness + 1e-12


class _Fusion:
    def __init__(self, *powers: float):
        self.powers, self.total, self.weight, self.only, self.n = powers, 0.0, 0.0, None, 0

    def add(self, p: np.ndarray, z: int, value: float | None) -> None:
        w = quality(p, *self.powers)[..., None]
        self.total, self.weight, self.n = self.total + p * w, self.weight + w, self.n + 1
        self.only = p.copy() if self.n == 1 else None

    def result(self) -> np.ndarray:
        return self.only if self.n == 1 else self.total / self.weight


def exposure_fusion(images: DataFrame, contrast: float = 1.0, saturation: float = 1.0, exposedness: float = 1.0) -> DataFrame:
    """Exposures of one scene blended pixel by pixel by their quality; no stops are needed. A stack of one image is that image."""
    return fold(images, lambda: _Fusion(contrast, saturation, exposedness))


class _Sharpest:
    """The number in the stack of each place's sharpest image, the first of equal ones, as an image of one channel."""

    def __init__(self):
        self.best, self.at, self.n = None, None, 0

    def add(self, p: np.ndarray, z: int, value: float | None) -> None:
        v = p[..., :3].astype(np.int64)
        sharp = np.zeros(p.shape[:2], np.int64)
        sharp[1:-1, 1:-1] = np.abs(4 * v[1:-1, 1:-1] - v[1:-1, :-2] - v[1:-1, 2:] - v[:-2, 1:-1] - v[2:, 1:-1]).sum(2)
        if self.best is None:
            self.best, self.at = sharp, np.zeros(sharp.shape, np.int64)
        else:
            more = sharp > self.best
            self.best, self.at = np.where(more, sharp, self.best), np.where(more, self.n, self.at)
        self.n += 1

    def result(self) -> np.ndarray:
        return majority(self.at, 2)[..., None]


def majority(v: np.ndarray, radius: int) -> np.ndarray:
    """The most frequent value of the window about each place, the least of equally frequent ones."""
    best, out = np.zeros(v.shape, np.int64), v.copy()
    for value in np.unique(v):
        count = window_sums(v == value, radius)[0]
        out, best = np.where(count > best, value, out), np.maximum(best, count)
    return out


class _Chosen:
    """Takes each place from the image that the map (the first of the stack) names."""

    def __init__(self):
        self.map, self.out, self.n = None, None, 0

    def add(self, p: np.ndarray, z: int, value: float | None) -> None:
        if self.map is None:
            self.map = p[..., 0].copy()
            return
        if self.out is None:
            self.out = np.zeros(p.shape, "<u2")
        here = self.map == self.n
        self.out[here] = p[here]
        self.n += 1

    def result(self) -> np.ndarray:
        return self.out


def focus_map(images: DataFrame) -> DataFrame:
    """The number (from 0, in order of z) of the sharpest image at each place, smoothed by a majority of 5 x 5."""
    return fold(images, _Sharpest)


def focus_stack(images: DataFrame) -> DataFrame:
    """Focal planes of one scene as one image that is sharp everywhere: a fold for the map, and one that picks."""
    chosen = focus_map(images).select(F.col("image_id").alias("seq_id"), F.lit(-(1 << 31)).cast("int").alias("z"), *frames.COLUMNS)
    rows = images.select(F.col("seq_id").cast("long"), F.col("z").cast("int"), *frames.COLUMNS)
    return fold(chosen.unionByName(rows), _Chosen)
