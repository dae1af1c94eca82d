"""Operators against formulas and invariants that don't come from SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import blend, colorspaces, generators, point
from pixelweave.functions.quantum import M, from_byte, to_byte
from pixelweave.operators import compare, filters, frames, geometry, hashes, histogram, kernels, layers, neighbourhood, regions, stitching
from pixelweave.plans import expression, steps
from pixelweave.sources import codecs, rasters

KEY = ["image_id", "y", "x"]


def array(df, columns="rgb"):
    pdf = df.toPandas()
    out = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1, len(columns)), int)
    out[pdf.y, pdf.x] = pdf[list(columns)]
    return out


@pytest.fixture(scope="module")
def image(spark):
    """A small image of repeating patterns, 9 x 7."""
    df = rasters.grid(spark, 9, 7)
    x, y = F.col("x"), F.col("y")
    return df.select(*KEY, (((x * 7 + y * 13) * 9 % 256) * 257).alias("r"), (((x * 11 + y * 3) * 7 % 256) * 257).alias("g"), (((x * 5 + y * 17) * 5 % 256) * 257).alias("b"), F.lit(None).cast("int").alias("a")).cache()


def test_bytes_round_trip(spark):
    got = spark.range(256).select(to_byte(from_byte(F.col("id"))).alias("b"), "id").where("b <> id").count()
    assert got == 0


def test_involutions(image):
    whole = array(image)
    for f in (point.invert, geometry.flip, geometry.flop, geometry.transpose, geometry.transverse):
        assert (array(f(f(image))) == whole).all()
    turned = image
    for _ in range(4):
        turned = geometry.rotate(turned, 90)
    assert (array(turned) == whole).all()
    assert (array(geometry.roll(geometry.roll(image, 3, 2), -3, -2)) == whole).all()


def test_equal_images_have_no_error(image):
    r = compare.measures(image, image).first()
    assert (r.mse, r.mae, r.pae, r.ae, r.psnr) == (0, 0, 0, 0, float("inf"))


def test_blur_equals_numpy(image):
    w = neighbourhood.gaussian_weights(0.8)
    p = np.pad(array(image).astype(float), ((3, 3), (3, 3), (0, 0)), mode="edge")
    one = sum(w[k] * p[:, k : k + 9] for k in range(7))
    two = sum(w[k] * one[k : k + 7] for k in range(7))
    assert (np.abs(array(neighbourhood.gaussian_blur(image, 0.8)) - np.floor(two + 0.5)) <= 1).all()


def test_opening_is_idempotent(image):
    e = neighbourhood.element("square", 1)
    once = neighbourhood.opening(image, e)
    assert (array(neighbourhood.opening(once, e)) == array(once)).all()


@pytest.mark.parametrize("name", sorted(colorspaces.SPACES))
def test_colour_round_trip(spark, name):
    df = rasters.gradient(spark, 17, 11)
    back = colorspaces.restore(colorspaces.convert(df, name), name)
    # the fixed matrices between D65 and D50, to and fro, are rounded to five places and not each other's inverse
    assert np.abs(array(back) - array(df)).max() <= (0.005 * M if name == "prophoto" else 1)


@pytest.mark.parametrize("kind", sorted(codecs.CODECS))
def test_codecs_round_trip(spark, image, kind):
    p = array(image)
    decode, encode = codecs.CODECS[kind]
    got = decode(encode(p))
    assert (got[:, :, :3] == p).all()
    content = encode(p)
    row = spark.createDataFrame([(bytearray(content), f"/x.{kind}")], "content binary, path string").select(F.coalesce(codecs.detect(F.col("content")), codecs.detect_extension(F.col("path"))).alias("f")).first()
    assert row.f == kind
    if kind in ("farbfeld", "png", "qoi"):
        q = np.concatenate([p, np.arange(63).reshape(7, 9, 1) % 4 * 257 * 50], axis=2)
        assert (decode(encode(q)) == q).all()


def test_broken_file_is_a_row_with_its_error(spark):
    df = spark.createDataFrame([(1, "a.png", bytearray(b"\x89PNG\r\n\x1a\n??")), (2, "b.xyz", bytearray(b"hello"))], "image_id long, path string, content binary")
    assert all(r.error for r in codecs.decode(df).collect())
    assert codecs.to_pixels(codecs.decode(df)).count() == 0


def test_files_of_a_folder(spark, image, tmp_path):
    for kind in ("png", "tga", "qoi"):
        (tmp_path / f"i.{kind}").write_bytes(codecs.CODECS[kind][1](array(image)))
    images = codecs.read_images(spark, f"file://{tmp_path}")
    assert sorted((r.format, r.width, r.height) for r in images.collect()) == [("png", 9, 7), ("qoi", 9, 7), ("tga", 9, 7)]
    assert codecs.to_pixels(images).count() == 3 * 63


def test_expression_errors():
    for text in ("u.q", "1 +", "nope(1)", "min(1)", "(1", "$"):
        with pytest.raises(expression.ExpressionError):
            expression.Compiler(text).compile()


def test_expression_values(image):
    def value(text):
        return expression.apply(image, text).where("x = 0 and y = 0").first().r

    assert value("-2^2 == 4 ? 1 : 0") == M and value("2^3^0 == 2") == M
    assert value("1/0") == 0 and value("5 % 0") == 0 and value("!0 && 1 || 0") == M
    assert value("round(2.5)/4 + trunc(-1.5)*0") == M // 2 + 1
    assert value("hypot(3,4)/5 - gauss(0) + sinc(0)") == M


def test_crop_moves_before_blur(image):
    text = ["blur 0.5", "invert", "crop 2 2 4 3"]
    planned = steps.plan([steps.parse(t) for t in text])
    assert [s.name for s in planned] == ["crop", "blur", "crop", "invert"] or [s.name for s in planned][0] == "crop"
    assert (array(steps.execute(image, text)) == array(steps.execute(image, text, optimize=False))).all()
    corner = ["boxblur 1", "median 1", "crop 0 0 3 3", "crop 1 1 2 2"]
    assert (array(steps.execute(image, corner)) == array(steps.execute(image, corner, optimize=False))).all()
    fluent = steps.Pipeline(image).invert().crop(1, 1, 3, 3).to_frame()
    assert (array(fluent) == M - array(image)[1:4, 1:4]).all()
    for bad in ("", "nosuch", "crop 1"):
        with pytest.raises(ValueError):
            steps.parse(bad)


def test_components_and_distance(spark):
    mask = ["##..#", "#...#", "..#..", "....#"]
    rows = [(0, y, x, M * (c == "#"), M * (c == "#"), M * (c == "#"), None) for y, line in enumerate(mask) for x, c in enumerate(line)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int")
    got = {r.label: (r.area, r.x, r.y, r.w, r.h) for r in regions.components(df, 0.5, 4).collect()}
    assert got == {1: (3, 0, 0, 2, 2), 2: (2, 4, 0, 1, 2), 3: (1, 2, 2, 1, 1), 4: (1, 4, 3, 1, 1)}
    assert regions.distance_transform(df, "manhattan").agg(F.max("v")).first()[0] == M
    assert regions.flood_select(df, 0, 0, 10).where("v > 0").count() == 3


def test_hash_join_finds_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 20)
    values = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 62, int(rng.integers(0, 8)))) for b in base for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(values)), "image_id long, hash long")
    first = {}
    for k, v in enumerate(values):
        first.setdefault(v, k)
    want = {(a, b) for v, a in first.items() for w, b in first.items() if a < b and ((v ^ w) & (2**64 - 1)).bit_count() <= 6}
    want |= {(first[v], k) for k, v in enumerate(values) if k != first[v]}
    for most in (6, 0, 1, 3, 9, 15):
        links = {(a, b) for a, b in want if ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= most}
        if most > 6:
            links = {(a, b) for v, a in first.items() for w, b in first.items() if a < b and ((v ^ w) & (2**64 - 1)).bit_count() <= most} | {(first[v], k) for k, v in enumerate(values) if k != first[v]}
        got = [(r.a, r.b, r.distance) for r in hashes.similar(df, most).collect()]
        assert len(got) == len(set(got)) and {(a, b) for a, b, _ in got} == links and links
        assert all(((values[a] ^ values[b]) & (2**64 - 1)).bit_count() == d for a, b, d in got)
    assert df.select(hashes.from_hex(hashes.to_hex(F.col("hash"))).alias("h"), "hash").where("h <> hash").count() == 0


def sent_through_driver(df):
    """The parts of a plan that are broadcast, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k, line in enumerate(lines):
        if line.lstrip(" :+-").startswith("BroadcastExchange"):
            yield "\n".join(lines[k : next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))])


@pytest.mark.parametrize("most", [3, 15])
def test_looked_up_bands_are_not_sent_through_the_driver(spark, most):
    df = spark.range(50).selectExpr("id as image_id", "xxhash64(id) as hash")
    assert not any("Generate" in part for part in sent_through_driver(hashes.similar(df, most)))


def test_images_are_not_sent_through_the_driver(spark):
    images = frames.made(spark, 4, 64, 64)
    pairs = spark.range(3).selectExpr("id as a", "id + 1 as b")
    for df in (stitching.stitch(pairs, images), stitching.align(pairs, stitching.features(images)), stitching.laplacian_blend(images, images, images), frames.mse(images, images), frames.combine(images, images, lambda p, q: p)):
        assert not any("MapInArrow" in part for part in sent_through_driver(df))


def test_matches_with_one_point_count_once_and_nothing_is_mirrored():
    words = lambda *v: np.array([[x, 0, 0, 0] for x in v], np.uint64)
    far = (1 << 40) - 1
    one, two = np.array([[0.0, 0], [1, 0], [2, 0]]), np.array([[5.0, 5], [9, 9]])
    src, dst = stitching.matched(one, two, words(1, 0, far << 20), words(0, far << 20), 0.75)
    assert src.tolist() == [[1, 0], [2, 0]] and dst.tolist() == [[5, 5], [9, 9]]
    square = np.array([[[0.0, 0], [9, 0], [9, 9], [0, 9]]])
    assert stitching.turned(square, square * [-1, 1]).all() and not stitching.turned(square, square * 2 + 3).any()


def test_seams_and_dither(image):
    assert array(kernels.seam_carve(image, 6, 9)).shape == (9, 6, 3)
    out = array(kernels.dither(image, "atkinson"))
    assert set(np.unique(out)) <= {0, M}


def test_frames_are_replayed(spark):
    cols = "seq_id long, scene int, page_x int, page_y int, dispose string, y int, x int, r int, g int, b int, a int"
    rows = [(0, 0, 0, 0, "none", 0, 0, 9, 9, 9, M), (0, 1, 1, 0, "background", 0, 0, 5, 5, 5, M), (0, 2, 0, 1, "previous", 0, 0, 7, 7, 7, M), (0, 3, 1, 1, "none", 0, 0, 3, 3, 3, M)]
    got = layers.coalesce_frames(spark.createDataFrame(rows, cols), 2, 2).orderBy("scene", "y", "x").collect()
    assert [[r.r for r in got if r.scene == k] for k in range(4)] == [[9, 0, 0, 0], [9, 5, 0, 0], [9, 0, 7, 0], [9, 0, 0, 3]]


def test_layers_and_sheets(spark, image):
    flat = layers.flatten([{"pixels": image}, {"pixels": point.invert(image), "visible": False}], 9, 7, spark)
    assert (array(flat) == array(image)).all()
    two = image.union(point.invert(image).withColumn("image_id", F.lit(1).cast("long")))
    names = spark.createDataFrame([(0, "a"), (1, "b")], "image_id long, name string")
    sheet, text = layers.sprite_sheet(two, names, 2, 1)
    assert sheet.count() == 126 and '"name":"b","x":12,"y":1' in text.first().json


def test_constant_image_is_safe(spark):
    df = generators.solid(spark, 4, 4, (300, 300, 300))
    for f in (histogram.normalize, histogram.auto_level, histogram.auto_gamma, histogram.white_balance, histogram.apply_otsu):
        f(df).count()
    assert array(geometry.trim(df), "a").tolist() == [[[0]]]
    assert array(blend.composite(df, df, "difference")).max() == 0
    assert (array(generators.apply_hald(df, generators.identity_hald(spark, 3), 3)) == 300).all()


def test_streamed_files(spark, image, tmp_path):
    from pixelweave.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(codecs.CODECS["png"][1](array(image)))
    stream = ingest.image_stream(spark, f"file://{tmp_path}/in").select("image_id", "format", "width", "error")
    query = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.format, r.width, r.error) for r in spark.table("streamed").collect()] == [("png", 9, None)]


def plain_bilinear(p, x, y):
    h, w = p.shape[:2]
    x0, y0 = int(np.floor(x)), int(np.floor(y))
    at = lambda i, j: p[min(max(j, 0), h - 1), min(max(i, 0), w - 1)]
    top, low = at(x0, y0) + (at(x0 + 1, y0) - at(x0, y0)) * (x - x0), at(x0, y0 + 1) + (at(x0 + 1, y0 + 1) - at(x0, y0 + 1)) * (x - x0)
    return np.floor(top + (low - top) * (y - y0) + 0.5)


def test_directional_blurs_pixel_by_pixel(spark, sf):
    image = rasters.rgb(spark, sf).where("image_id = 3 and x < 7")
    p = array(image).astype(float)
    h, w = p.shape[:2]

    def mean(x, y, places):
        found = [(k, p[round(b), round(a)]) for k, a, b in places(x, y) if 0 <= round(a) < w and 0 <= round(b) < h]
        return np.floor(sum(k * v for k, v in found) / sum(k for k, _ in found) + 0.5)

    turn = np.radians(30)
    motion = lambda x, y: [(np.exp(-n * n / 2), x + n * np.cos(turn), y + n * np.sin(turn)) for n in range(-2, 3)]
    steps = max(3, int(2 * 20 * np.sqrt(np.hypot(w / 2, h / 2))) + 1)
    steps += steps % 2 == 0
    spin = [(k - steps // 2) * np.radians(20) / (steps - 1) for k in range(steps)]
    radial = lambda x, y: [(1, (x - w / 2) * np.cos(t) - (y - h / 2) * np.sin(t) + w / 2, (x - w / 2) * np.sin(t) + (y - h / 2) * np.cos(t) + h / 2) for t in spin]
    for got, places in ((filters.motion_blur(image, 2, 1.0, 30.0), motion), (filters.radial_blur(image, 20.0), radial)):
        want = np.array([[mean(x, y, places) for x in range(w)] for y in range(h)])
        assert np.abs(array(got) - want).max() <= 1


def test_wave_implode_and_vignette_pixel_by_pixel(spark, sf):
    image = rasters.rgb(spark, sf).where("image_id = 3 and x < 7")
    p = array(image).astype(float)
    h, w = p.shape[:2]
    shift = lambda x: 2 + 1.5 * np.sin(2 * np.pi * x / 5)
    waved = [[plain_bilinear(p, x, y - shift(x)) if 0 <= y - shift(x) < h - 1 else np.zeros(3) for x in range(w)] for y in range(h + 4)]
    assert np.abs(array(filters.wave(image, 1.5, 5.0)) - waved).max() <= 1

    def pinched(x, y):
        dx, dy = x - w / 2, (y - h / 2) * w / h
        d, radius = np.hypot(dx, dy), min(w, h) / 2
        if d >= radius:
            return p[y, x]
        k = np.sin(np.pi / 2 * d / radius) ** -0.4 if d > 0 else 1.0
        return plain_bilinear(p, min(max(k * dx + w / 2, 0), w - 1), min(max(k * dy * h / w + h / 2, 0), h - 1))

    assert np.abs(array(filters.implode(image, 0.4)) - [[pinched(x, y) for x in range(w)] for y in range(h)]).max() <= 1
    out = array(filters.vignette(image, 1.0))
    assert (out <= p).all() and (out[h // 2, w // 2] > 0.9 * p[h // 2, w // 2]).all() and (out[0, 0] < 0.5 * p[0, 0]).all()


def test_large_images_become_pixels_in_linear_time(spark):
    import struct
    import time
    import zlib

    n = 512  # a PNG file made here, without the library's own writer
    raw = np.random.default_rng(1).integers(0, 256, (n, n, 3), dtype=np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in raw))) + chunk(b"IEND", b"")
    files = spark.createDataFrame([(1, "x.png", bytearray(png))], "image_id long, path string, content binary")
    begun = time.time()
    got = codecs.to_pixels(codecs.decode(files)).orderBy("y", "x").select("r", "g", "b").toArrow()
    assert (np.stack([got.column(c).to_numpy() for c in "rgb"], 1).reshape(n, n, 3) == raw.astype(int) * 257).all()
    assert time.time() - begun < 20
