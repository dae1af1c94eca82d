"""Operators on whole images against those on tables of pixels."""

import numpy as np
import pytest

from pixelweave.operators import compare, filters, frames, geometry, histogram, kernels, neighbourhood
from pixelweave.sources import codecs, rasters

from .test_engine import array


@pytest.fixture(scope="module")
def both(spark):
    images = frames.made(spark, 2, 19, 14, 1)
    return images, back(images).cache()


back = codecs.to_pixels


def near(images, pixels, most=1):
    for k in range(2):
        one, two = array(back(images).where(f"image_id = {k}")), array(pixels.where(f"image_id = {k}"))
        assert one.shape == two.shape and np.abs(one - two).max() <= most


def test_there_and_back(both):
    images, pixels = both
    near(frames.from_pixels(pixels), pixels, 0)


@pytest.mark.parametrize("name", ["blur", "sharpen", "motion", "normalize", "equalize", "lanczos3", "triangle", "sample", "canny", "carve"])
def test_operators(both, name):
    images, pixels = both
    size = (19, 14)
    pairs = {
        "blur": lambda: (frames.gaussian_blur(images, 1.0), neighbourhood.gaussian_blur(pixels, 1.0)),
        "sharpen": lambda: (frames.sharpen(images, 1.0, 0.8), neighbourhood.sharpen(pixels, 1.0, 0.8)),
        "motion": lambda: (frames.motion_blur(images, 3, 1.5, 33.0), filters.motion_blur(pixels, 3, 1.5, 33.0)),
        "normalize": lambda: (frames.normalize(images), histogram.normalize(pixels)),
        "equalize": lambda: (frames.equalize(images), rasters.to_wide(histogram.equalize(rasters.to_long(pixels)))),
        "lanczos3": lambda: (frames.resize(images, 9, 22), geometry.resize(pixels, size, (9, 22))),
        "triangle": lambda: (frames.resize(images, 30, 7, "triangle"), geometry.resize(pixels, size, (30, 7), "triangle")),
        "sample": lambda: (frames.sample(images, 12, 5), geometry.sample(pixels, size, (12, 5))),
        "canny": lambda: (frames.canny(images, 0.8, 0.05, 0.1), filters.canny(pixels, 0.8, 0.05, 0.1)),
        "carve": lambda: (frames.seam_carve(images, 15, 12), kernels.seam_carve(pixels, 15, 12)),
    }
    near(*pairs[name]())


def test_measures(both):
    images, pixels = both
    other, soft = frames.gaussian_blur(images, 1.0), back(frames.gaussian_blur(images, 1.0))
    want = {r.image_id: r.mse for r in compare.measures(pixels, soft).collect()}
    got = {r.image_id: r.mse for r in frames.mse(images, other).collect()}
    assert set(got) == {0, 1} and all(got[k] == pytest.approx(want[k], rel=1e-4) or got[k] * 65535**2 == pytest.approx(want[k], rel=1e-4) for k in got)
    whole = images.where("image_id = 0")
    assert frames.ssim(whole, whole).first().ssim == pytest.approx(1.0) and 0 < frames.ssim(images, other).first().ssim < 1


def test_demosaic_of_a_plane_is_exact_inside(spark):
    y, x = np.mgrid[0:10, 0:12]
    plane = np.stack([x * 900 + y * 500 + 4000, x * 700 + 9000, y * 800 + 6000], 2)
    images = spark.createDataFrame([(0, 12, 10, 3, bytearray(plane.astype("<u2").tobytes()))], frames.SCHEMA)
    got = array(back(frames.demosaic(frames.mosaic(images))))
    assert np.abs(got[1:-1, 1:-1] - plane[1:-1, 1:-1]).max() <= 1


def test_composite_and_files(both):
    images, pixels = both
    overlay = np.dstack([np.full((5, 6, 3), 50_000), np.full((5, 6, 1), 32_768)])
    got = array(back(frames.composite_over(images, overlay, 4, 3)).where("image_id = 0"))
    p = array(pixels.where("image_id = 0")).astype(float)
    p[3:8, 4:10] += (50_000 - p[3:8, 4:10]) * (32_768 / 65_535)
    assert np.abs(got - p).max() <= 1
    files = frames.encode(images, "png").selectExpr("image_id", "'x.png' AS path", "content")
    near(codecs.decode(files), pixels, 0)
