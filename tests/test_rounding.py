"""Sums near a half: results do not depend on the order of sums or on single precision."""

import math

import numpy as np
from pyspark.sql import functions as F

from pixelweave.functions import blend
from pixelweave.functions.quantum import M, luma
from pixelweave.operators import filters, frames, histogram, retouch, stacks
from pixelweave.plans import expression

RNG = np.random.default_rng(7)


def pixels(spark, p, image_id=0):
    h, w = p.shape[:2]
    return spark.createDataFrame([(image_id, y, x, *map(int, p[y, x]), None) for y in range(h) for x in range(w)], "image_id long, y int, x int, r int, g int, b int, a int")


def array(df):
    rows = df.orderBy("y", "x").collect()
    return np.array([(r.r, r.g, r.b) for r in rows])


def frame(spark, p):
    return spark.createDataFrame([(0, p.shape[1], p.shape[0], p.shape[2], bytearray(p.astype("<u2").tobytes()))], frames.SCHEMA)


def data(df, channels=3):
    r = df.first()
    return np.frombuffer(bytes(r.data), "<u2").reshape(r.height, r.width, channels)


def test_luma_of_gray_is_gray(spark):
    """hide_mark takes the floor of it, bumpmaps divide it."""
    gray = spark.range(M + 1).select(F.col("id").cast("int").alias("v"))
    assert gray.where(F.floor(luma("601", "v", "v", "v")) != F.col("v")).count() == 0


def test_bump_is_exact(spark):
    q = RNG.integers(0, M + 1, (2_000_000, 3))
    q = q[(q @ [299, 587, 114]) % 1000 == 500][:1600].reshape(40, 40, 3)
    got = array(blend.composite(pixels(spark, np.full(q.shape, M)), pixels(spark, q), "bumpmap"))
    assert (got[:, 0] == np.floor((q @ [299, 587, 114]) / 1000 / M * M + 0.5).reshape(-1)).all()


def test_intensity_weighs_unit_values(spark):
    v = RNG.integers(0, M + 1, (12_000_000, 3))
    v = v[(v @ [212656, 715158, 72186]) % 1_000_000 == 500_000][:400]
    want = np.floor((v[:, 0] / M * 0.212656 + v[:, 1] / M * 0.715158 + v[:, 2] / M * 0.072186) * M + 0.5)
    df = spark.createDataFrame([(k, 0, 0, *map(int, x), None) for k, x in enumerate(v)], "image_id long, y int, x int, r int, g int, b int, a int")
    got = [r.r for r in expression.apply(df, "intensity").orderBy("image_id").collect()]
    assert len(v) and got == want.tolist()


def test_implode_rounds_to_six_digits(spark):
    k = math.sin(math.pi / 2 * math.hypot(1, 1) / 4) ** -0.5
    f = 4 + k - 5
    q = RNG.integers(0, M + 1, (6_000_000, 4)).astype(float)
    v = (q[:, 0] * (1 - f) + q[:, 1] * f) * (1 - f) + (q[:, 2] * (1 - f) + q[:, 3] * f) * f
    at = np.flatnonzero((v % 1 > 0.4999995) & (v % 1 < 0.5))[:1]
    assert len(at) and 0 <= f < 1
    p = np.zeros((8, 8, 3), int)
    p[5:7, 5:7] = q[at[0]].reshape(2, 2, 1)
    assert (array(filters.implode(pixels(spark, p)))[5 * 8 + 5] == math.floor(v[at[0]]) + 1).all()


def test_auto_gamma_puts_the_mean_at_the_upper_half(spark):
    means = RNG.integers(1000, 60000, 40)
    df = None
    for k, m in enumerate(means.tolist()):
        p = np.full((1, 3, 3), m)
        p[0, 0], p[0, 2] = m - 500, m + 500
        df = pixels(spark, p, k) if df is None else df.union(pixels(spark, p, k))
    got = histogram.auto_gamma(df).where("x = 1").select("r").distinct().collect()
    assert [r.r for r in got] == [32768]


def test_inpainting_of_a_tie_goes_up():
    hole = np.zeros((9, 9), bool)
    hole[4, 4] = True
    square = ((np.mgrid[0:9, 0:9] - 4) ** 2).sum(0)
    near = (square > 0) & (square <= 9)
    weights = 360 // square[near]
    v = RNG.integers(0, M + 1, (300_000, len(weights)))
    top, low = v @ weights, weights.sum()
    ties = np.flatnonzero((2 * top) % (2 * low) == low)
    assert len(ties) > 9
    for k in ties:
        p = np.zeros((9, 9, 1), int)
        p[near, 0] = v[k]
        assert retouch.fill_from_edge(p, hole, 3)[4, 4, 0] == top[k] // low + 1


def test_merged_exposures_weigh_by_ordered_luma():
    for _ in range(400):
        merge, total, weight = stacks._Merge(), 0.0, 0.0
        for z in range(3):
            v = RNG.integers(0, M + 1, (8, 8, 3)).astype("<u2")
            merge.add(v, z, z - 1)
            v = v.astype(float)
            light = (v[..., 0] * 0.2126 + v[..., 1] * 0.7152 + v[..., 2] * 0.0722) / M
            w = np.where(light <= 0.5, 2 * light, 2 * (1 - light))[..., None]
            total, weight = total + w * (v / M / 2.0 ** (z - 1)), weight + w
        radiance = total / weight
        assert (merge.result()[..., :3] == np.clip(radiance * (M / radiance.max()), 0, M).astype("<u2")).all()


def test_whole_images_in_double_precision(spark):
    p = RNG.integers(0, M + 1, (300, 300, 3))
    image = frame(spark, p)
    top = np.dstack([np.full((300, 300, 3), 60000), RNG.integers(0, M + 1, (300, 300, 1))])
    exact = (2 * (p * M + (top[..., :3] - p) * top[..., 3:]) + M) // (2 * M)
    assert (data(frames.composite_over(image, top, 0, 0)) == exact).all()
    k = math.exp(-0.5)
    wide = p.astype(float)
    want = wide.copy()
    want[:, 1:-1] = (wide[:, 1:-1] + k * wide[:, :-2] + k * wide[:, 2:]) / (1 + 2 * k)
    want[:, 0], want[:, -1] = (wide[:, 0] + k * wide[:, 1]) / (1 + k), (wide[:, -1] + k * wide[:, -2]) / (1 + k)
    assert (data(frames.motion_blur(image, 1, 1.0, 0.0)) == np.floor(np.round(want, 9) + 0.5)).all()
    assert frames.blurred(p, 0.6).dtype == np.float64 and frames._taps(8, 12, "catrom")[1].dtype == np.float64
    near = frame(spark, np.clip(p + RNG.integers(-9, 10, p.shape), 0, M))
    q = data(near).astype(float)
    block = lambda v: (v @ (filters.LUMA / M))[:296, :296].reshape(37, 8, 37, 8).transpose(0, 2, 1, 3).reshape(-1, 64)
    a, b = block(p.astype(float)), block(q)
    both = ((a - a.mean(1, keepdims=True)) * (b - b.mean(1, keepdims=True))).mean(1)
    ssim = ((2 * a.mean(1) * b.mean(1) + 1e-4) * (2 * both + 9e-4) / ((a.mean(1) ** 2 + b.mean(1) ** 2 + 1e-4) * (a.var(1) + b.var(1) + 9e-4))).mean()
    assert abs(frames.ssim(image, near).first().ssim - ssim) < 1e-12
