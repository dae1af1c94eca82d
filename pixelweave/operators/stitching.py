"""Stitching: corners with binary descriptors, matches of image pairs, homographies, and blending in bands.

Features of an image are one row of packed arrays. A pair of images becomes a row by two joins on ids (no image meets any but
those it is paired with), and matching, the homography and the panorama are computed in that row: distances are exclusive-ors
and bit counts of bounded blocks, so a task holds one pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantum import M
from ..sources.batches import follow
from . import frames
from .attention import window_sums
from .selection import _shifted
from .stacks import LUMA

PATCH, BITS = 31, 256
IDENTITY = np.array([1.0, 0, 0, 0, 1, 0, 0, 0])

View = Callable[[np.ndarray], np.ndarray]


def luma(p: np.ndarray) -> np.ndarray:
    return p[..., :3].astype(np.float64) @ LUMA


def corners(p: np.ndarray, most: int = 500, quality: float = 0.01, block: int = 3, k: float = 0.04) -> np.ndarray:
    """(x, y, response) of strict local maxima above a share of the greatest, strongest first, then by place."""
    gray = luma(p) / M
    h, w = gray.shape
    reach, half = max(3, block), block // 2
    if min(h, w) <= 2 * reach:
        return np.zeros((0, 3))
    at = lambda dy, dx: gray[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
    gx, gy = np.zeros((h, w)), np.zeros((h, w))
    gx[1:-1, 1:-1] = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + at(1, 1) - at(1, -1)
    gy[1:-1, 1:-1] = at(1, -1) - at(-1, -1) + 2 * (at(1, 0) - at(-1, 0)) + at(1, 1) - at(-1, 1)
    xx, yy, xy = (window_sums(v, half)[0] for v in (gx * gx, gy * gy, gx * gy))
    response = np.zeros((h, w))
    inner = (slice(half + 1, h - half - 1), slice(half + 1, w - half - 1))
    response[inner] = (xx * yy - xy * xy - k * (xx + yy) ** 2)[inner]
    peak = response > response.max() * quality
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dy or dx:
                peak &= _shifted(response, dy, dx, np.inf) < response
    peak[:reach] = peak[h - reach :] = peak[:, :reach] = peak[:, w - reach :] = False
    y, x = np.nonzero(peak)
    order = np.lexsort((x, y, -response[y, x]))[:most]
    return np.stack([x[order], y[order], response[y, x][order]], 1)


def test_pairs(patch: int = PATCH, seed: int = 12345) -> np.ndarray:
    """(BITS, 4) offsets ax, ay, bx, by of a descriptor's comparisons: seeded, the same for every image."""
    half = patch // 2
    return np.random.default_rng(seed).integers(-half, half + 1, (BITS, 4))


def describe(p: np.ndarray, points: np.ndarray, patch: int = PATCH) -> np.ndarray:
    """(n, 4) words: a bit is 1 where the first place of its pair is darker, in luma smoothed by means of 5 x 5; 0 too near the edge."""
    total, n = window_sums(luma(p), 2)
    h, w = total.shape
    smooth = np.zeros((h, w))
    smooth[2 : h - 2, 2 : w - 2] = (total / n)[2 : h - 2, 2 : w - 2]
    x, y = points[:, 0].astype(int), points[:, 1].astype(int)
    pairs = test_pairs(patch)
    read = lambda dx, dy: smooth[np.clip(y[:, None] + dy, 0, h - 1), np.clip(x[:, None] + dx, 0, w - 1)]
    bits = read(pairs[:, 0], pairs[:, 1]) < read(pairs[:, 2], pairs[:, 3])
    half = patch // 2
    bits &= ((x >= half) & (x < w - half) & (y >= half) & (y < h - half))[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def match(a: np.ndarray, b: np.ndarray, ratio: float = 0.75, block: int = 64) -> np.ndarray:
    """(i, j, distance): each descriptor of ``a`` with its nearest of ``b``, where that is clearly nearer than the second; first of equal ones."""
    out = []
    for at in range(0, len(a) if len(b) else 0, block):
        d = np.bitwise_count(a[at : at + block, None] ^ b[None]).sum(2, dtype=np.int64)
        best = d.argmin(1)
        near = d[np.arange(len(d)), best]
        rest = d.copy()
        rest[np.arange(len(d)), best] = 1 << 30
        second = rest.min(1)
        ok = (second > 0) & (near < ratio * second)
        out.append(np.stack([np.flatnonzero(ok) + at, best[ok], near[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def matched(one: np.ndarray, two: np.ndarray, da: np.ndarray, db: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of both images that belong together: of the matches with one descriptor of the second image the nearest, the first of equal ones."""
    m = match(da, db, ratio)
    m = m[np.lexsort((m[:, 0], m[:, 2]))]
    m = m[np.sort(np.unique(m[:, 1], return_index=True)[1])]
    m = m[np.argsort(m[:, 0])]
    return one[m[:, 0]], two[m[:, 1]]


def turned(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Whether three of four points, (n, 4, 2), turn the other way round in ``dst``: no two views of one side of a plane show that."""

    def sides(p: np.ndarray) -> np.ndarray:
        a, b, c = (p[:, [t[k] for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]] for k in range(3))
        return np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))

    return (sides(src) != sides(dst)).any(1)


def homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """(n, 8) homographies through four pairs of points each, (n, 4, 2); NaN where the points fix none."""
    unit = max(1.0, float(np.abs(src).max(initial=0)), float(np.abs(dst).max(initial=0)))
    x, y, u, v = src[..., 0] / unit, src[..., 1] / unit, dst[..., 0] / unit, dst[..., 1] / unit
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -x * u, -y * u], 2), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v], 2)], 1)
    ok = np.abs(np.linalg.det(rows)) > 1e-14
    out = np.full((len(src), 8), np.nan)
    out[ok] = np.linalg.solve(rows[ok], np.concatenate([u, v], 1)[ok][..., None])[..., 0] * [1, 1, unit, 1, 1, unit, 1 / unit, 1 / unit]
    return out


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(..., n, 2) of points (n, 2) under homographies (..., 8); infinite where a point has no image."""
    h = h[..., None, :]
    x, y = points[:, 0], points[:, 1]
    w = h[..., 6] * x + h[..., 7] * y + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack([(h[..., 0] * x + h[..., 1] * y + h[..., 2]) / w, (h[..., 3] * x + h[..., 4] * y + h[..., 5]) / w], -1)
    return np.where(np.abs(w)[..., None] < 1e-10, np.inf, out)


def estimate(src: np.ndarray, dst: np.ndarray, iterations: int = 1000, near: float = 3.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(homography, inliers): of seeded samples of four matches the one with the least squared errors, each at most ``near``, the first of equal ones.

    Errors count, not only matches within ``near``: a bent view that comes near a few wrong matches too doesn't beat the exact one.
    It is then fitted by least squares to the inliers whose errors are not out of line with the median, as long as that lessens the
    errors. Fewer than four matches give the identity.
    """
    if len(src) < 4:
        return IDENTITY.copy(), np.zeros(len(src), bool)

    def errors(h: np.ndarray) -> np.ndarray:
        far = np.linalg.norm(project(h, src) - dst, axis=-1)
        return np.where(np.isfinite(far), far, np.inf)

    def cost(far: np.ndarray) -> np.ndarray:
        return (np.minimum(far, near) ** 2).sum(-1)

    rng = np.random.default_rng(seed)
    samples = rng.random((iterations, len(src))).argpartition(3, axis=1)[:, :4] if len(src) <= 4096 else np.stack([rng.choice(len(src), 4, replace=False) for _ in range(iterations)])
    found = homographies(src[samples], dst[samples])
    found[turned(src[samples], dst[samples])] = np.nan
    best, far, least = IDENTITY.copy(), np.full(len(src), np.inf), near * near * len(src)
    for at in range(0, iterations, 64):
        part = errors(found[at : at + 64])
        costs = cost(part)
        k = int(costs.argmin())
        if costs[k] < least:
            best, far, least = found[at + k], part[k], costs[k]
    while (far < near).sum() > 4:
        #: Fixed value: 2.5 standard deviations, of which a median of normal errors is 0.6745.
        kept = far <= max(2.5 / 0.6745 * float(np.median(far[far < near])), 1e-3)
        x, y, u, v = src[kept, 0], src[kept, 1], dst[kept, 0], dst[kept, 1]
        zero, one = np.zeros_like(x), np.ones_like(x)
        rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -x * u, -y * u], 1), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v], 1)])
        fitted = np.linalg.lstsq(rows, np.concatenate([u, v]), rcond=None)[0]
        again = errors(fitted)
        if kept.sum() <= 4 or cost(again) >= least * (1 - 1e-9):
            break
        best, far, least = fitted, again, cost(again)
    return best, far < near


# --- bands --------------------------------------------------------------------------------------------------------------------------


def _smoothed(v: np.ndarray) -> np.ndarray:
    """Binomial of five taps along both axes, edges repeated."""
    for axis in (0, 1):
        wide = np.pad(v, [(2, 2) if a == axis else (0, 0) for a in range(v.ndim)], mode="edge")
        part = lambda k, axis=axis, wide=wide, n=v.shape[axis]: wide.take(range(k, k + n), axis)
        v = (part(0) + part(4) + 4 * (part(1) + part(3)) + 6 * part(2)) / 16
    return v


def _down(v: np.ndarray) -> np.ndarray:
    return _smoothed(v)[::2, ::2]


def _up(v: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Twice the size: new places are means of their neighbours."""
    for axis in (0, 1):
        n = shape[axis]
        at = np.arange(n) / 2
        low = np.minimum(np.floor(at).astype(int), v.shape[axis] - 1)
        high = np.minimum(np.ceil(at).astype(int), v.shape[axis] - 1)
        v = (v.take(low, axis) + v.take(high, axis)) / 2
    return v


def blend_bands(a: np.ndarray, b: np.ndarray, share: np.ndarray, levels: int = 4) -> np.ndarray:
    """``a`` where ``share`` (h, w, from 0 to 1) is 1 and ``b`` where it is 0, each band of detail mixed over a width of its own."""
    a, b, share = a.astype(np.float64), b.astype(np.float64), share.astype(np.float64)[..., None]
    bands = []
    for _ in range(levels - 1):
        if min(a.shape[:2]) < 2:
            break
        small = [_down(v) for v in (a, b, share)]
        bands.append((a - _up(small[0], a.shape)) * share + (b - _up(small[1], b.shape)) * (1 - share))
        a, b, share = small
    out = a * share + b * (1 - share)
    for band in reversed(bands):
        out = _up(out, band.shape) + band
    return out


def panorama(a: np.ndarray, b: np.ndarray, h: np.ndarray, levels: int = 4) -> np.ndarray:
    """Both images on the canvas of ``a``; ``h`` leads from places of ``a`` to those of ``b``. At most the size of both beside each other.

    Where only one image is, its pixels stand on both sides of the blend, so that no dark edge bleeds in.
    """
    (ha, wa), (hb, wb) = a.shape[:2], b.shape[:2]
    matrix = np.append(h, 1.0).reshape(3, 3)
    back = np.linalg.inv(matrix)
    back = (back / back[2, 2]).reshape(-1)[:8]
    ends = project(back, np.array([[0.0, 0], [wb - 1, 0], [wb - 1, hb - 1], [0, hb - 1]]))
    if not np.isfinite(ends).all():
        return a
    left, top = (min(0, int(np.floor(v + 1e-6))) for v in ends.min(0))
    right, bottom = (max(n - 1, int(np.ceil(v - 1e-6))) for n, v in zip((wa, ha), ends.max(0), strict=True))
    width, height = min(right - left + 1, wa + wb), min(bottom - top + 1, 2 * max(ha, hb))
    yy, xx = np.mgrid[top : top + height, left : left + width]
    at = project(h, np.stack([xx.reshape(-1), yy.reshape(-1)], 1).astype(float)).reshape(height, width, 2)
    at = np.where(np.isfinite(at), at, -1)
    has_b = (at[..., 0] >= -1e-6) & (at[..., 0] <= wb - 1 + 1e-6) & (at[..., 1] >= -1e-6) & (at[..., 1] <= hb - 1 + 1e-6)
    bx, by = np.clip(at[..., 0], 0, wb - 1), np.clip(at[..., 1], 0, hb - 1)
    x0, y0 = np.minimum(bx.astype(int), max(wb - 2, 0)), np.minimum(by.astype(int), max(hb - 2, 0))
    x1, y1 = np.minimum(x0 + 1, wb - 1), np.minimum(y0 + 1, hb - 1)
    fx, fy = (bx - x0)[..., None], (by - y0)[..., None]
    warped = (b[y0, x0] * (1 - fx) + b[y0, x1] * fx) * (1 - fy) + (b[y1, x0] * (1 - fx) + b[y1, x1] * fx) * fy
    has_a = (xx >= 0) & (xx < wa) & (yy >= 0) & (yy < ha)
    placed = a[np.clip(yy, 0, ha - 1), np.clip(xx, 0, wa - 1)].astype(np.float64)
    only_a, only_b = has_a & ~has_b, has_b & ~has_a
    one, two = np.where(only_b[..., None], warped, placed), np.where(has_b[..., None] & ~only_a[..., None], warped, placed)
    share = np.where(only_a, 1.0, np.where(only_b, 0.0, 0.5))
    out = blend_bands(one, two, share, levels)
    return np.where((has_a | has_b)[..., None], np.floor(np.clip(out, 0, M) + 0.5), 0)


# --- tables -------------------------------------------------------------------------------------------------------------------------

FEATURES = "image_id long, n int, points binary, descriptors binary"


def features(images: DataFrame, most: int = 500, patch: int = PATCH) -> DataFrame:
    """image_id, n, points (x, y as int32), descriptors (four words each) of the strongest corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in frames.COLUMNS], strict=True):
                p = frames._array(row)
                points = corners(p, most)
                values = [row[0].as_py()], [len(points)], [points[:, :2].astype("<i4").tobytes()], [describe(p, points, patch).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["image_id", "n", "points", "descriptors"])

    return follow(images, frames.COLUMNS, run, FEATURES)


ALIGNED = "a long, b long, matches int, inliers int, homography array<double>"


def align(pairs: DataFrame, found: DataFrame, ratio: float = 0.75, iterations: int = 1000, near: float = 3.0, seed: int = 42) -> DataFrame:
    """a, b, matches, inliers and the homography from ``a`` to ``b`` (eight numbers, row by row) of each pair of image ids.

    Features of hundreds of points an image are shuffled by id, never sent through the driver.
    """
    side = lambda s: found.select(F.col("image_id").alias(s), F.col("points").alias(f"p{s}"), F.col("descriptors").alias(f"d{s}"))
    rows = pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, pa_, da, pb, db in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "pa", "da", "pb", "db")], strict=True):
                one, two = (np.frombuffer(v, "<i4").reshape(-1, 2).astype(float) for v in (pa_, pb))
                src, dst = matched(one, two, np.frombuffer(da, "<u8").reshape(-1, 4), np.frombuffer(db, "<u8").reshape(-1, 4), ratio)
                h, inliers = estimate(src, dst, iterations, near, seed)
                out.append((a, b, len(src), int(inliers.sum()), h.tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "matches", "inliers", "homography"])

    return rows.select("a", "b", "pa", "da", "pb", "db").mapInArrow(run, ALIGNED)


def stitch(pairs: DataFrame, images: DataFrame, most: int = 500, ratio: float = 0.75, levels: int = 4, views: tuple[View, View] | None = None, beside: bool = False) -> DataFrame:
    """One panorama for each pair (image_id: that of ``a``); a pair of fewer than four matches gives its first image.

    Images meet by two shuffles on ids, whatever their number; corners are found where the pair is, so that no image goes twice.
    ``views`` make the first and the second view of a pair from the stored images where the pair is: what is shuffled is the stored
    image, not an enlarged one. With ``beside`` the stored image of ``a`` stays in the row (``frames.BOTH``), for ``frames.measure_rows``.
    """
    side = lambda s: images.select(F.col("image_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in frames.COLUMNS[1:]])
    rows = pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    if views:  # few bytes, much work: tasks by number, which Spark doesn't draw together by their bytes
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (frames._array((batch.column(s)[k], *[batch.column(f"{s}_{c}")[k] for c in frames.COLUMNS[1:]])) for s in "ab")
                if views:
                    one, two = (np.ascontiguousarray(view(p)) for view, p in zip(views, (one, two), strict=True))
                found = [corners(p, most) for p in (one, two)]
                src, dst = matched(*[c[:, :2] for c in found], *[describe(p, c) for p, c in zip((one, two), found, strict=True)], ratio)
                out = frames._row(batch.column("a")[k].as_py(), panorama(one, two, estimate(src, dst)[0], levels) if len(src) >= 4 else one)
                if beside:
                    out = pa.RecordBatch.from_arrays([*out.columns, *[batch.column(f"a_{c}").slice(k, 1) for c in frames.COLUMNS[1:]]], names=frames.BOTH)
                yield out

    return follow(rows, rows.columns, run, frames.BOTH_SCHEMA if beside else frames.SCHEMA)


def laplacian_blend(images: DataFrame, others: DataFrame, masks: DataFrame, levels: int = 4) -> DataFrame:
    """Images over others of the same id by a mask of it, in bands; white is the first."""
    mask = masks.select("image_id", *[F.col(c).alias(f"m_{c}") for c in frames.COLUMNS[1:]])
    over = others.select("image_id", *[F.col(c).alias(f"o_{c}") for c in frames.COLUMNS[1:]])
    rows = images.select(*frames.COLUMNS).join(over.hint("merge"), "image_id").join(mask.hint("merge"), "image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, m = (frames._array((batch.column("image_id")[k], *[batch.column(s + c)[k] for c in frames.COLUMNS[1:]])) for s in ("", "o_", "m_"))
                h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
                out = blend_bands(a[:h, :w], b[:h, :w], m[:h, :w, 0] / M, levels)
                yield frames._row(batch.column("image_id")[k].as_py(), np.floor(np.clip(out, 0, M) + 0.5))

    return follow(rows, rows.columns, run, frames.SCHEMA)
