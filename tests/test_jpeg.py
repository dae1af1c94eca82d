"""JPEG files against Java's own reader and writer, which this library has no part in."""

import tracemalloc

import numpy as np
import pytest

from pixelweave.operators import compare
from pixelweave.sources import codecs, jpeg, rasters


def picture(h, w, seed=3):
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    waves = [np.sin(x / a + y / b) * 0.4 + 0.5 for a, b in ((5.0, 9.0), (11.0, -4.0), (-3.0, 17.0))]
    return (np.clip(np.stack(waves, 2) + rng.normal(0, 0.03, (h, w, 3)), 0, 1) * 255).astype(int) * 257


@pytest.fixture(scope="module")
def java(spark):
    """(write, read) by javax.imageio; skipped where the Java runtime has no desktop module."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    try:
        io = jvm.javax.imageio.ImageIO
        writer = io.getImageWritersByFormatName("jpeg").next()
    except Exception:  # noqa: BLE001
        pytest.skip("no javax.imageio here")

    def write(p, progressive, gray=False):
        h, w = p.shape[:2]
        image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
        raster = image.getRaster()
        for y in range(h):
            for x in range(w):
                if gray:
                    raster.setSample(x, y, 0, int(p[y, x, 0] // 257))
                else:
                    image.setRGB(x, y, int(p[y, x, 0] // 257) << 16 | int(p[y, x, 1] // 257) << 8 | int(p[y, x, 2] // 257))
        out = jvm.java.io.ByteArrayOutputStream()
        stream = io.createImageOutputStream(out)
        writer.setOutput(stream)
        parameters = writer.getDefaultWriteParam()
        parameters.setProgressiveMode(1 if progressive else 0)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), parameters)
        stream.close()
        return bytes(out.toByteArray())

    def read(data):
        image = io.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
        if image.getRaster().getNumBands() == 1:  # getRGB would apply a gray profile
            return np.array([[[image.getRaster().getSample(x, y, 0)] * 3 for x in range(image.getWidth())] for y in range(image.getHeight())]) * 257
        return np.array([[[image.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(image.getWidth())] for y in range(image.getHeight())]) * 257

    return write, read


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("gray", [False, True])
def test_reads_what_java_writes(java, progressive, gray):
    write, read = java
    data = write(picture(37, 45), progressive, gray)
    assert (b"\xff\xc2" in data) == progressive
    mine, theirs = jpeg.decode(data), read(data)
    # Java blends subsampled colours where these decoders repeat them, so single values may differ; means may not
    assert mine.shape == theirs.shape and np.abs(mine - theirs).mean() < (3 if gray else 9) * 257
    if gray:
        assert np.abs(mine - theirs).max() <= 2 * 257


@pytest.mark.parametrize("sampling", ["444", "422", "420"])
@pytest.mark.parametrize("progressive", [False, True])
def test_java_reads_what_is_written(java, sampling, progressive):
    p = picture(21, 30)
    data = jpeg.encode(p, 90, sampling, progressive)
    mine, theirs = jpeg.decode(data), java[1](data)
    assert theirs.shape == p.shape and np.abs(theirs - p).mean() < (8 if sampling == "444" else 16) * 257
    if sampling == "444":
        assert np.abs(mine - theirs).max() <= 3 * 257


def test_transform_is_orthonormal_and_quantisers_scale():
    blocks = np.random.default_rng(0).normal(0, 50, (20, 8, 8))
    assert np.allclose(jpeg.inverse(jpeg.forward(blocks)), blocks) and np.isclose((jpeg.forward(blocks) ** 2).sum(), (blocks**2).sum())
    assert (jpeg.quantiser(jpeg.LUMA_QUANTISER, 50) == jpeg.LUMA_QUANTISER).all() and (jpeg.quantiser(jpeg.CHROMA_QUANTISER, 100) == 1).all()
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-1] == 63 and jpeg.ZIGZAG[-2] == 62


def test_huffman_codes_are_prefix_free_and_short():
    rng = np.random.default_rng(2)
    for counts in ({5: 1}, {1: 1, 2: 1}, {k: 2**k for k in range(40)}, {int(k): int(n) for k, n in enumerate(rng.integers(1, 9000, 200))}):
        number, symbols, codes = jpeg.huffman(counts)
        assert sorted(symbols) == sorted(counts) and sum(number) == len(counts) and all(0 < n <= 16 for _, n in codes.values())
        texts = sorted(format(c, f"0{n}b") for c, n in codes.values())
        assert all(not b.startswith(a) for a, b in zip(texts, texts[1:])) and all("0" in t for t in texts)


def test_broken_files_are_rows_with_errors(spark):
    good = jpeg.encode(picture(16, 16))
    files = spark.createDataFrame([(k, "x.jpg", bytearray(c)) for k, c in enumerate((good, good[:300], b"\xff\xd8\xff\xd9", b"\xff\xd8abcdef"))], "image_id long, path string, content binary")
    rows = {r.image_id: r for r in codecs.decode(files).collect()}
    assert rows[0].error is None and (rows[0].width, rows[0].height, rows[0].format) == (16, 16, "jpeg")
    assert all(rows[k].error and rows[k].data is None for k in (2, 3))


def test_images_through_files(spark, sf):
    image = rasters.gradient(spark, 24, 16)
    files = codecs.encode(image, "jpeg").selectExpr("image_id", "'x.jpg' AS path", "content")
    back = codecs.to_pixels(codecs.decode(files))
    assert compare.measures(image, back).first().psnr > 35


def test_tables_of_a_file_are_small():
    number, symbols, _ = jpeg.huffman({s: s + 1 for s in range(200)})
    tracemalloc.start()
    tables = [jpeg._lookup(number, symbols) for _ in range(8)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(tables[0]) == 1 << 16
    assert held < 8 << 18
    # fewer symbols than codes are still an error
    with pytest.raises(IndexError):
        jpeg._lookup(number, symbols[:-1])
