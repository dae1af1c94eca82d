"""Whole images as rows: image_id, width, height, channels, data (16-bit values, row by row), one numpy call an image.

The form for images of thousands of pixels a side: nothing is shuffled, a task holds one Arrow batch of images (whose bytes
Spark bounds) and one image's arrays at a time. ``from_pixels`` and ``codecs.to_pixels`` change from and to tables of pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantum import M
from ..sources.batches import follow
from .filters import LUMA, canny_pixels
from .geometry import contributions
from .kernels import carve, carve_stack
from .neighbourhood import gaussian_weights

SCHEMA = "image_id long, width int, height int, channels int, data binary"
COLUMNS = ["image_id", "width", "height", "channels", "data"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _array(row: tuple) -> np.ndarray:
    _, w, h, c, data = row
    return np.frombuffer(data.as_buffer(), "<u2").reshape(h.as_py(), w.as_py(), c.as_py())


def _row(image_id, p: np.ndarray) -> pa.RecordBatch:
    if p.dtype != np.uint16:
        p = np.clip(p, 0, M).astype("<u2")
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((image_id, p.shape[1], p.shape[0], p.shape[2], p.tobytes()), KINDS, strict=True)], names=COLUMNS)


def apply(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Each image's (h, w, c) array of unsigned 16-bit values through ``f``; results are clamped and truncated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in COLUMNS], strict=True):
                yield _row(row[0].as_py(), f(_array(row)))

    return follow(images, COLUMNS, run, SCHEMA)


#: Pixels of images of one size that ``apply_stacks`` hands over together.
STACK_PIXELS = 1 << 20


def apply_stacks(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """As ``apply``, for functions of several images of one size, (n, h, w, c): images that follow each other in a batch go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray]] = []

            def flush(held: list = held) -> Iterator[pa.RecordBatch]:
                if held:
                    for (key, _), p in zip(held, f(np.stack([p for _, p in held])), strict=True):
                        yield _row(key, p)
                    held.clear()

            for row in zip(*[batch.column(c) for c in COLUMNS], strict=True):
                p = _array(row)
                if held and (held[0][1].shape != p.shape or (len(held) + 1) * p.shape[0] * p.shape[1] > STACK_PIXELS):
                    yield from flush()
                held.append((row[0].as_py(), p))
            yield from flush()

    # not in the process of a step before, which gives batches of one image
    return follow(images.select(*COLUMNS), COLUMNS, run, SCHEMA)


def measure(images: DataFrame, other: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """image_id and measures of each image and the one of its id in ``other``: one join of image rows."""
    right = other.select("image_id", *[F.col(c).alias(f"o_{c}") for c in COLUMNS[1:]])
    return measure_rows(images.join(right.hint("merge"), "image_id"), f, names)


#: Two images in a row, the second one's columns with ``o_`` before their names.
BOTH = [*COLUMNS, *[f"o_{c}" for c in COLUMNS[1:]]]
BOTH_SCHEMA = f"{SCHEMA}, o_width int, o_height int, o_channels int, o_data binary"


def measure_rows(both: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """As ``measure``, of rows that hold both images (``BOTH``): nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c) for c in BOTH], strict=True):
                found = f(_array(row[:5]), _array((row[0], *row[5:])))
                out.append((row[0].as_py(), *[float(found[n]) for n in names]))
            columns = list(zip(*out, strict=True)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64() if k else pa.int64()) for k, c in enumerate(columns)], names=["image_id", *names])

    return follow(both, BOTH, run, "image_id long, " + ", ".join(f"{n} double" for n in names))


def combine(images: DataFrame, other: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One image of each and the one of its id in ``other`` (a mask, a trimap, a second image): one join of image rows."""
    right = other.select("image_id", *[F.col(c).alias(f"o_{c}") for c in COLUMNS[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in [*COLUMNS, *[f"o_{c}" for c in COLUMNS[1:]]]], strict=True):
                yield _row(row[0].as_py(), f(_array(row[:5]), _array((row[0], *row[5:]))))

    both = images.select(*COLUMNS).join(right.hint("merge"), "image_id")
    return follow(both, both.columns, run, SCHEMA)


def from_pixels(df: DataFrame) -> DataFrame:
    """Image rows of a table of pixels: one group an image, sorted in the JVM."""
    alpha = F.col("a").isNotNull()
    flat = df.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.when(F.bool_and(alpha), 4).otherwise(3).alias("channels"), F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column("channels")[k].as_py()
                planes = [batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in "rgba"[:n]]
                shape = batch.column("height")[k].as_py(), batch.column("width")[k].as_py(), n
                yield _row(batch.column("image_id")[k].as_py(), np.stack(planes, axis=1).astype("<u2").reshape(shape))

    return follow(flat, ["image_id", "width", "height", "channels", *[F.col(f"p.{c}").alias(c) for c in "rgba"]], run, SCHEMA)


def made(spark: SparkSession, count: int, width: int, height: int, partitions: int | None = None) -> DataFrame:
    """Test images: diagonal waves whose phase is the image's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:height, 0:width]
        for batch in batches:
            for k in batch.column("id").to_pylist():
                planes = [(np.sin(x / a + y / b + k) * 0.45 + 0.5 + ((x * 7 + y * 13 + k) % 16) / 400) * M for a, b in ((17.0, 29.0), (41.0, -13.0), (-9.0, 53.0))]
                yield _row(k, np.stack(planes, axis=2))

    return follow(spark.range(0, count, 1, partitions), ["id"], run, SCHEMA)


# --- operators ----------------------------------------------------------------------------------------------------------------------


def _half_up(p: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves go up, after the last digits of a sum, which depend on its order, are rounded away."""
    return np.clip(np.floor(np.round(p, digits) + 0.5), 0, M).astype("<u2")


def _taps(source: int, target: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """For each target place its source places and their weights, filled up with weights of zero."""
    found: list[list[tuple[int, float]]] = [[] for _ in range(target)]
    for t, s, w in contributions(source, target, method):
        found[t].append((s, w))
    most = max(map(len, found))
    found = [x + [(x[0][0], 0.0)] * (most - len(x)) for x in found]
    return np.array([[s for s, _ in x] for x in found]), np.array([[w for _, w in x] for x in found])


def _weighted(v: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows as weighted sums of rows."""
    out = v[places[:, 0]] * weights[:, 0, None]
    for k in range(1, places.shape[1]):
        out += v[places[:, k]] * weights[:, k, None]
    return out


def resized(width: int, height: int, method: str = "lanczos3") -> Callable[[np.ndarray], np.ndarray]:
    """An image as one of another size: along y, then along x, each as sums of a few weighted lines; rounded once."""
    made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
        if (source, target) not in made:
            made[source, target] = _taps(source, target, method)
        return made[source, target]

    def f(p: np.ndarray) -> np.ndarray:
        h, w, c = p.shape
        tall = _weighted(p.reshape(h, w * c).astype(np.float64), *taps(h, height))
        lines = np.ascontiguousarray(tall.reshape(height, w, c).transpose(1, 0, 2)).reshape(w, height * c)
        wide = _weighted(lines, *taps(w, width)).reshape(width, height, c)
        return _half_up(np.ascontiguousarray(wide.transpose(1, 0, 2)))

    return f


def resize(images: DataFrame, width: int, height: int, method: str = "lanczos3") -> DataFrame:
    return apply(images, resized(width, height, method))


def sample(images: DataFrame, width: int, height: int) -> DataFrame:
    """The nearest pixel."""
    near = lambda n, m: np.minimum(((np.arange(m) + 0.5) * n / m).astype(int), n - 1)
    return apply(images, lambda p: np.ascontiguousarray(p[near(p.shape[0], height)][:, near(p.shape[1], width)]))


def blurred(p: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, edges repeated."""
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    v = p.astype(np.float64)
    for axis in (0, 1):
        n = v.shape[axis]
        wide = np.concatenate([np.repeat(v.take([0], axis), r, axis), v, np.repeat(v.take([n - 1], axis), r, axis)], axis)
        at = lambda k, wide=wide, n=n, axis=axis: wide[k : k + n] if axis == 0 else wide[:, k : k + n]
        v = at(r) * weights[r]
        for k in range(r):  # the kernel is symmetric
            v += (at(k) + at(2 * r - k)) * weights[k]
    return v


def gaussian_blur(images: DataFrame, sigma: float) -> DataFrame:
    return apply(images, lambda p: _half_up(blurred(p, sigma)))


def sharpen(images: DataFrame, sigma: float, amount: float = 1.0) -> DataFrame:
    def f(p: np.ndarray) -> np.ndarray:
        soft = np.floor(np.round(blurred(p, sigma), 6) + 0.5)
        return _half_up(p + (p - soft) * amount)

    return apply(images, f)


def _moved(n: int, by: float) -> tuple[object, object]:
    """Places along an axis whose place moved by a real distance, rounded half to even, lies inside, and those places.

    Slices, but for halves that rounding sends both ways.
    """
    at = np.rint(np.arange(n) + by).astype(int)
    here = np.flatnonzero((at >= 0) & (at < n))
    there = at[here]
    if len(here) and (np.diff(there) == 1).all():
        return slice(here[0], here[-1] + 1), slice(there[0], there[-1] + 1)
    return here, there


def motion_blur(images: DataFrame, radius: int, sigma: float, degrees: float) -> DataFrame:
    """A Gaussian along a direction; what lies outside the image doesn't count."""
    dx, dy = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def f(p: np.ndarray) -> np.ndarray:
        h, w = p.shape[:2]
        total, weight = np.zeros(p.shape), np.zeros((h, w, 1))
        for n in range(-radius, radius + 1):
            k = math.exp(-n * n / (2 * sigma * sigma))
            (hy, ty), (hx, tx) = _moved(h, n * dy), _moved(w, n * dx)
            if isinstance(hy, slice) and isinstance(hx, slice):
                total[hy, hx] += p[ty, tx] * k
                weight[hy, hx] += k
            else:
                rows, columns = (np.arange(v.start, v.stop) if isinstance(v, slice) else v for v in (hy, hx))
                from_rows, from_columns = (np.arange(v.start, v.stop) if isinstance(v, slice) else v for v in (ty, tx))
                total[np.ix_(rows, columns)] += p[np.ix_(from_rows, from_columns)] * k
                weight[np.ix_(rows, columns)] += k
        return _half_up(total / weight, 9)

    return apply(images, f)


def normalize(images: DataFrame) -> DataFrame:
    """The range of all colours to the whole range; a flat image stays."""

    def f(p: np.ndarray) -> np.ndarray:
        low, high = int(p[..., :3].min()), int(p[..., :3].max())
        if high <= low:
            return p
        table = np.floor(np.clip((np.arange(M + 1) - low) / (high - low), 0, 1) * M + 0.5).astype("<u2")
        out = table[p]
        out[..., 3:] = p[..., 3:]
        return out

    return apply(images, f)


def _bytes(p: np.ndarray) -> np.ndarray:
    v = p.astype(np.uint32) + 128
    return ((v - (v >> 8)) >> 8).astype(np.uint8)


def equalize(images: DataFrame) -> DataFrame:
    """Each channel by the cumulative histogram of its 256 bins; a flat one becomes black."""

    def f(p: np.ndarray) -> np.ndarray:
        out, level = p.copy(), _bytes(p)
        for c in range(min(3, p.shape[2])):
            cum = np.bincount(level[..., c].reshape(-1), minlength=256).cumsum()
            first = cum[cum > 0][0]
            out[..., c] = np.floor(np.maximum(cum - first, 0) / max(cum[-1] - first, 1) * M + 0.5).astype("<u2")[level[..., c]]
        return out

    return apply(images, f)


def composite_over(images: DataFrame, overlay: np.ndarray, x: int, y: int) -> DataFrame:
    """A (h, w, 4) overlay of 16-bit values at a place of every image."""
    top, share = overlay[..., :3].astype(np.int64), overlay[..., 3:].astype(np.int64)

    def f(p: np.ndarray) -> np.ndarray:
        out = p.copy()
        h, w = min(p.shape[0] - y, top.shape[0]), min(p.shape[1] - x, top.shape[1])
        part = out[y : y + h, x : x + w, :3]
        out[y : y + h, x : x + w, :3] = _half_up(part + (top[:h, :w] - part) * share[:h, :w] / M, 9)
        return out

    return apply(images, f)


def canny(images: DataFrame, sigma: float = 1.0, low: float = 0.1, high: float = 0.3) -> DataFrame:
    return apply(images, lambda p: canny_pixels(p[..., :3].astype(float), sigma, low, high))


def seam_carve(images: DataFrame, width: int, height: int) -> DataFrame:
    """Least seams out of stacks of images of one size; where an image grows, image by image."""

    def along(stack: np.ndarray, size: int) -> np.ndarray:
        if size <= stack.shape[2]:
            return carve_stack(stack, size)
        return np.stack([carve(p.astype(float), size) for p in stack]).astype("<u2")

    def f(stack: np.ndarray) -> np.ndarray:
        tall = along(np.ascontiguousarray(stack[..., :3]), width).transpose(0, 2, 1, 3)
        return np.ascontiguousarray(along(np.ascontiguousarray(tall), height).transpose(0, 2, 1, 3))

    return apply_stacks(images, f)


def mse(images: DataFrame, other: DataFrame) -> DataFrame:
    """image_id, mse: the mean squared difference of values as 0..1, by blocks of rows."""

    def f(p: np.ndarray, q: np.ndarray) -> dict[str, float]:
        total = 0.0
        for a in range(0, len(p), 64):
            d = p[a : a + 64].astype(np.float64) - q[a : a + 64]
            total += float(np.vdot(d, d))
        return {"mse": total / p.size / M / M}

    return measure(images, other, f, ["mse"])


def ssim(images: DataFrame, other: DataFrame, block: int = 8) -> DataFrame:
    """image_id, ssim: the mean of whole blocks' similarity of luma."""

    def f(p: np.ndarray, q: np.ndarray) -> dict[str, float]:
        h, w = (n // block * block for n in p.shape[:2])
        cut = lambda v: (v[:h, :w, :3].astype(np.float64) @ (LUMA / M)).reshape(h // block, block, w // block, block).transpose(0, 2, 1, 3).reshape(-1, block * block)
        a, b = cut(p), cut(q)
        ma, mb = a.mean(1, keepdims=True), b.mean(1, keepdims=True)
        da, db = a - ma, b - mb
        va, vb, both = (da * da).mean(1), (db * db).mean(1), (da * db).mean(1)
        ma, mb = ma[:, 0], mb[:, 0]
        c1, c2 = 0.01**2, 0.03**2
        return {"ssim": ((2 * ma * mb + c1) * (2 * both + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean()}

    return measure(images, other, f, ["ssim"])


def mosaic(images: DataFrame) -> DataFrame:
    """What a sensor behind an RGGB filter records: one value a pixel."""

    def f(p: np.ndarray) -> np.ndarray:
        out = p[..., 1:2].copy()
        out[::2, ::2, 0], out[1::2, 1::2, 0] = p[::2, ::2, 0], p[1::2, 1::2, 2]
        return out

    return apply(images, f)


def demosaic(images: DataFrame) -> DataFrame:
    """Colours of an RGGB mosaic (one channel): each missing one is the mean of its known neighbours, edges mirrored."""

    def f(p: np.ndarray) -> np.ndarray:
        v = np.pad(p[..., 0].astype(np.float32), 1, mode="reflect")
        h, w = p.shape[:2]
        at = lambda dy, dx: v[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        cross = (at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1)) / 4
        corners = (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)) / 4
        row, column = (at(0, -1) + at(0, 1)) / 2, (at(-1, 0) + at(1, 0)) / 2
        out = np.empty((h, w, 3), np.float32)
        own = at(0, 0)
        out[..., 0], out[..., 1], out[..., 2] = own, own, own
        # red places, green ones of red and of blue rows, blue places
        out[::2, ::2, 1], out[::2, ::2, 2] = cross[::2, ::2], corners[::2, ::2]
        out[::2, 1::2, 0], out[::2, 1::2, 2] = row[::2, 1::2], column[::2, 1::2]
        out[1::2, ::2, 0], out[1::2, ::2, 2] = column[1::2, ::2], row[1::2, ::2]
        out[1::2, 1::2, 0], out[1::2, 1::2, 1] = corners[1::2, 1::2], cross[1::2, 1::2]
        return np.floor(out + 0.5).astype("<u2")  # quarters of whole values: exact, nothing to round away

    return apply(images, f)


def encode(images: DataFrame, kind: str, **options) -> DataFrame:
    """image_id, content: files, without a shuffle."""
    from ..sources.codecs import codec

    put = codec(kind)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in COLUMNS], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([row[0].as_py()], pa.int64()), pa.array([put(_array(row).astype(np.int32), **options)], pa.binary())], names=["image_id", "content"])

    return follow(images, COLUMNS, run, "image_id long, content binary")
