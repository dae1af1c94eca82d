"""Paths, transforms, matrices and size rules against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import adjust, drawing, noise
from pixelweave.operators import geometry, histogram
from pixelweave.sources import rasters


def test_paths():
    assert drawing.parse_path("M1 2 L3,4 h2 v-1 Z m1 1 l1 0") == [[(1, 2), (3, 4), (5, 4), (5, 3), (1, 2)], [(2, 3), (3, 3)]]
    curve = drawing.parse_path("M0 0 C0 1 1 1 1 0 Q2 -2 3 0")[0]
    assert curve[0] == (0, 0) and curve[16] == (1, 0) and curve[-1] == pytest.approx((3, 0)) and curve[24][1] == pytest.approx(-1)
    for text in ("1 2", "M0 0 Z 3 4", "M0 0 L1"):
        with pytest.raises(ValueError):
            drawing.parse_path(text)


def test_dashes_and_corners():
    assert drawing.dashed([(0, 0), (10, 0)], (3, 2)) == [((0, 0), (3, 0)), ((5, 0), (8, 0))]
    assert [p for p, _ in drawing.dashed([(0, 0), (2, 0), (2, 5)], (3, 1))] == [(0, 0), (2, 0), (2, 2)]
    assert drawing.regular_polygon(0, 0, 2, 4)[0] == pytest.approx((0, -2)) and len(drawing.star(0, 0, 2, 1, 5)) == 10
    assert all(math.hypot(*p) == pytest.approx(2 if k % 2 == 0 else 1) for k, p in enumerate(drawing.star(0, 0, 2, 1, 5)))


def test_transforms():
    t = drawing.Turtle()
    t.translate(10, 0)
    t.push()
    t.rotate(90)
    t.scale(2, 1)
    assert t.apply([(1, 0)])[0] == pytest.approx((10, 2))
    t.pop()
    assert t.apply([(1, 0)]) == [(11, 0)]
    m = adjust.Affine.rotation(33).then(adjust.Affine.scale(2, -3)).then(adjust.Affine.translation(4, 5))
    back = m.then(m.inverse()).m
    assert back == pytest.approx((1, 0, 0, 1, 0, 0))
    with pytest.raises(ValueError):
        adjust.Affine.scale(0, 1).inverse()


def test_sizes():
    assert geometry.thumbnail_size((300, 200), (100, 100)) == (100, 67) and geometry.thumbnail_size((1000, 1), (10, 10)) == (10, 1)


def test_moments_are_invariant(spark):
    y, x = np.mgrid[0:24, 0:24]
    shape = np.where((x - 9) ** 2 / 30 + (y - 12) ** 2 / 9 + (x - 9) * (y - 12) / 40 < 1, 65535, 0)
    images = [shape, np.rot90(shape), np.roll(shape, (3, 5), (0, 1))]
    rows = [(k, int(b), int(a), int(p[b, a])) for k, p in enumerate(images) for b in range(24) for a in range(24)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, r int").select("*", F.col("r").alias("g"), F.col("r").alias("b"))
    got = [list(r)[1:] for r in histogram.hu_moments(df).orderBy("image_id").collect()]
    assert np.allclose(got[0], got[1], rtol=1e-6, atol=1e-12) and np.allclose(got[0], got[2], rtol=1e-6, atol=1e-12) and got[0][0] > 0


def test_textures_are_smooth_and_centred(spark):
    grid = rasters.grid(spark, 40, 40).select((F.col("x") / 7.0).alias("x"), (F.col("y") / 7.0).alias("y"))
    for make in (noise.perlin, noise.simplex):
        got = grid.select(make(F.col("x"), F.col("y"), 3).alias("v"), make(F.col("x") + 1e-4, F.col("y"), 3).alias("w")).collect()
        v = np.array([r.v for r in got])
        assert -1.2 < v.min() < -0.2 < 0.2 < v.max() < 1.2 and abs(v.mean()) < 0.2
        assert max(abs(r.v - r.w) for r in got) < 0.01
    far = [r.v for r in grid.select(noise.worley(F.col("x"), F.col("y"), 3).alias("v")).collect()]
    assert 0 <= min(far) and max(far) < 1.5
