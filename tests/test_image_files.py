"""Pages, frames and tiles of files through the data source, its stream and its sink; WebP, TIFF, APNG and fax coding."""

import base64
import io
import os
import struct

import numpy as np
import pytest

from pixelweave.sources import ccitt, codecs, image_files, sequences, tiff, webp

RNG = np.random.default_rng(8)


def raster(h, w, c=3, deep=False):
    return RNG.integers(0, 65536 if deep else 256, (h, w, c)) * (1 if deep else 257)


def smooth(h, w, c=3):
    y, x = np.mgrid[:h, :w]
    return np.stack([(x * (k + 2) + y * 3) % 256 * 257 for k in range(c)], 2)


# --- WebP ---------------------------------------------------------------------------------------------------------------------------

#: One transparent pixel, and the same as an animation, as published in the format's feature tests.
FOREIGN = ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRlIAAABXRUJQVlA4WAoAAAASAAAAAAAAAAAAQU5JTQYAAAD/////AABBTk1GJgAAAAAAAAAAAAAAAAAAAGQAAABWUDhMDQAAAC8AAAAQBxAREYiI/gcA")
LOSSY = "UklGRiIAAABXRUJQVlA4IBYAAAAwAQCdASoBAAEADsD+JaQAA3AAAAAA"


def test_foreign_webp():
    for text in FOREIGN:
        (frame,) = webp.frames(base64.b64decode(text))
        assert frame["pixels"].tolist() == [[[0, 0, 0, 0]]]
    assert webp.canvas_size(base64.b64decode(FOREIGN[1])) == (1, 1) and frame["delay"] == 100
    with pytest.raises(ValueError, match="lossy"):
        webp.decode(base64.b64decode(LOSSY))


@pytest.mark.parametrize("shape", [(1, 1, 3), (1, 9, 4), (7, 1, 3), (33, 50, 4), (64, 64, 3)])
def test_webp_round_trip(shape):
    for p in (raster(*shape), smooth(*shape), np.full(shape, 257 * 9)):
        q = webp.decode(webp.encode(p))
        assert np.array_equal(q[..., :3], p[..., :3]) and (q.shape == p.shape and np.array_equal(q, p) or (p[..., 3:] == 65535).all())


class Plain:
    """Writes lossless data by hand: every choice of the format that the encoder does not make."""

    def __init__(self, w, h):
        self.w = webp.Writer()
        for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
            self.w.put(value, n)

    def pixels(self, words, main, cache=0, entropy=None):
        """Fixed codes of 8 bits for all five alphabets; with ``cache`` a repeated pixel is an index, with ``entropy`` two equal groups."""
        w = self.w
        w.put(int(cache > 0), 1)
        if cache:
            w.put(cache, 4)
        if main:
            w.put(int(entropy is not None), 1)
            if entropy is not None:
                w.put(0, 3)
                self.pixels(entropy << 8, False)
        n = 280 + (1 << cache if cache else 0)
        lengths = [[9] * (n - 1) + [9] if n <= 512 else [10] * n, [8] * 256, [8] * 256, [8] * 256, [6] * 40]
        groups = 1 if entropy is None else int(entropy.max()) + 1
        for _ in range(groups):
            codes = [webp._write_prefix(w, self.full(k)) for k in lengths]
        table = {}
        for v in words.reshape(-1).tolist():
            key = (0x1E35A7BD * v & 0xFFFFFFFF) >> 32 - cache if cache else None
            if cache and table.get(key) == v:
                w.put(*codes[0][280 + key])
                continue
            table[key] = v
            w.put(*codes[0][v >> 8 & 255])
            w.put(*codes[1][v >> 16 & 255])
            w.put(*codes[2][v & 255])
            w.put(*codes[3][v >> 24])

    @staticmethod
    def full(lengths):
        """A complete code: Huffman lengths of equal counts."""
        return webp._code_lengths(np.ones(len(lengths), int))


def test_webp_colour_cache_groups_and_transforms():
    words = RNG.integers(0, 1 << 32, 5)[RNG.integers(0, 5, (9, 13))]
    want = webp._planes(words)[:, :, (1, 2, 3, 0)]
    plain = Plain(13, 9)
    plain.w.put(0, 1)
    plain.pixels(words, True, cache=4, entropy=RNG.integers(0, 2, (3, 4)))
    assert np.array_equal(webp.vp8l_decode(plain.w.bytes()), want)
    # indexed colours, packed four to a pixel
    table = RNG.integers(0, 1 << 32, 4)
    index = RNG.integers(0, 4, (6, 10))
    plain = Plain(10, 6)
    plain.w.put(1, 1)
    plain.w.put(webp.INDEXED, 2)
    plain.w.put(3, 8)
    steps = webp._planes(table[None])
    steps[:, 1:] = (steps[:, 1:] - steps[:, :-1]) & 255
    plain.pixels(steps[..., 0] << 24 | steps[..., 1] << 16 | steps[..., 2] << 8 | steps[..., 3], False)
    plain.w.put(0, 1)
    packed = np.zeros((6, 3), np.int64)
    for k in range(10):
        packed[:, k // 4] |= index[:, k] << 2 * (k % 4)
    plain.pixels(packed << 8, True)
    assert np.array_equal(webp.vp8l_decode(plain.w.bytes()), webp._planes(table[index])[:, :, (1, 2, 3, 0)])
    # colour transform: what it adds is taken off here pixel by pixel
    h, w = 5, 7
    p = RNG.integers(0, 256, (h, w, 4))
    code = [(int(a), int(b), int(c)) for a, b, c in RNG.integers(0, 256, (4, 3))]
    s8 = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    left = p.copy()
    for y in range(h):
        for x in range(w):
            to_red, to_blue, red_to_blue = code[y // 4 * 2 + x // 4]
            r, g, b, _ = p[y, x].tolist()
            left[y, x, 0] = (r - (s8(to_red) * s8(g) >> 5)) & 255
            left[y, x, 2] = (b - (s8(to_blue) * s8(g) >> 5) - (s8(red_to_blue) * s8(r) >> 5)) & 255
    plain = Plain(w, h)
    plain.w.put(1, 1)
    plain.w.put(webp.CROSS_COLOR, 2)
    plain.w.put(0, 3)
    plain.pixels(np.array([[c << 16 | b << 8 | a for a, b, c in code[k : k + 2]] for k in (0, 2)]), False)
    plain.w.put(0, 1)
    plain.pixels(left[..., 3] << 24 | left[..., 0] << 16 | left[..., 1] << 8 | left[..., 2], True)
    assert np.array_equal(webp.vp8l_decode(plain.w.bytes()), p)


def test_every_predictor_mode_by_pixel():
    """Residuals of each mode, computed pixel by pixel from the standard's words, come back."""
    h, w = 9, 11
    p = RNG.integers(0, 256, (h, w, 4))

    def expected(mode, y, x):
        at = lambda yy, xx: [int(v) for v in p[yy, xx]]
        if y == 0:
            return [255, 0, 0, 0] if x == 0 else at(0, x - 1)
        if x == 0:
            return at(y - 1, 0)
        left, top, corner = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
        right = at(y - 1, x + 1) if x + 1 < w else at(y, 0)
        mean = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
        clamp = lambda v: min(max(v, 0), 255)
        if mode == 11:
            guess = [a + b - c for a, b, c in zip(left, top, corner)]
            return left if sum(abs(g - a) for g, a in zip(guess, left)) < sum(abs(g - b) for g, b in zip(guess, top)) else top
        if mode == 12:
            return [clamp(a + b - c) for a, b, c in zip(left, top, corner)]
        if mode == 13:
            return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner)]
        return [[255, 0, 0, 0], left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right))][mode]

    for mode in range(14):
        rest = np.array([[[(int(v) - e) & 255 for v, e in zip(p[y, x], expected(mode, y, x))] for x in range(w)] for y in range(h)])
        assert np.array_equal(webp._unpredict(rest, np.full((2, 2), mode), 3), p), mode


# --- fax ----------------------------------------------------------------------------------------------------------------------------


def slow_fax(data, w, h, kind, two):
    """A reader of single bits that compares texts with the standard's codes, and paints pixel by pixel."""
    bits = "".join(f"{b:08b}" for b in data)
    at, rows = 0, []

    def code(table):
        nonlocal at
        for n in range(1, 14):
            if bits[at : at + n] in table:
                at += n
                return table[bits[at - n : at]]
        raise ValueError

    def run(color):
        total = 0
        while True:
            n = code(ccitt.RUNS[color])
            total += n
            if n < 64:
                return total

    for y in range(h):
        row, above, color = [], rows[-1] if rows else [0] * w, 0
        flat = kind != 4
        if kind == 2:
            at += -at % 8
        if kind == 3:
            while bits[at : at + 12] != ccitt.EOL:
                at += 1
            at += 12
            if two:
                flat, at = bits[at] == "1", at + 1
        while len(row) < w:
            if flat:
                row += [color] * run(color)
                color ^= 1
                continue
            b = len(row)
            last = lambda k: above[k - 1] if k else 0
            while b < w and not (above[b] != last(b) and above[b] != color and (b > len(row) or not row)):
                b += 1
            b2 = b + 1
            while b2 < w and above[b2] == above[b2 - 1]:
                b2 += 1
            mode = code(ccitt.MODES)
            if mode == "pass":
                row += [color] * (min(b2, w) - len(row))
            elif mode == "horizontal":
                row += [color] * run(color)
                row += [color ^ 1] * run(color ^ 1)
            else:
                row += [color] * (b + mode - len(row))
                color ^= 1
        rows.append(row[:w])
    return np.array(rows)


def two_level(trial):
    h, w = int(RNG.integers(1, 16)), int(RNG.choice([1, 2, 7, 8, 64, 100, 1728, 3000, 6000]))
    m = (RNG.random((h, w)) < RNG.random()).astype(np.uint8) if trial % 2 else np.zeros((h, w), np.uint8)
    for _ in range(4):
        y, x = RNG.integers(0, h), RNG.integers(0, w)
        m[y : y + 5, x : x + int(RNG.integers(1, w + 1))] ^= 1
    return m


@pytest.mark.parametrize("kind,two", [(2, False), (3, False), (3, True), (4, False)])
def test_fax_against_a_slow_reader(kind, two):
    for trial in range(24):
        m = two_level(trial)
        data = ccitt.encode(m, kind, two)
        assert np.array_equal(ccitt.decode(data, m.shape[1], m.shape[0], kind, two), m)
        assert np.array_equal(slow_fax(data, m.shape[1], m.shape[0], kind, two), m)


def test_fax_known_codes_and_damage():
    # 1728 white pixels by themselves, and a second row that repeats them; then an end of block
    assert ccitt.encode(np.zeros((1, 1728), np.uint8), 3)[:3] == int("000000000001" + "010011011" + "001", 2).to_bytes(3, "big")
    assert ccitt.encode(np.zeros((2, 1728), np.uint8), 4) == int("11" + "000000000001" * 2 + "000000", 2).to_bytes(4, "big")
    codes = [sorted([*r, ccitt.EOL[:-1]]) for r in ccitt.RUNS]
    assert all(not b.startswith(a) for c in codes for a, b in zip(c, c[1:])) and all(len(c) == 105 for c in codes)
    half = ccitt.encode(np.ones((20, 40), np.uint8), 4)[:2]
    assert ccitt.decode(half, 40, 20, 4).shape == (20, 40) and ccitt.decode(b"", 5, 2, 3).sum() == 0


# --- TIFF and PNG -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("packing", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("layout", [{}, {"tile": 16}, {"strip_rows": 7}])
def test_tiff_pages(packing, layout):
    images = [raster(20, 33, 3, True), raster(1, 1, 4, True), raster(50, 7, 3, True)]
    data = tiff.encode(images, packing, **layout)
    assert all(np.array_equal(p.image(), q) for p, q in zip(tiff.pages(io.BytesIO(data)), images, strict=True))
    assert np.array_equal(codecs.codec("tiff")[0](data), images[0])


def test_tiff_fax_pages_big_planar_and_circles():
    m = two_level(1)
    p = np.where(m[:, :, None] == 1, 0, 65535).repeat(3, 2)
    for packing, two in ((2, False), (3, False), (3, True), (4, False)):
        for layout in ({}, {"strip_rows": 3}):
            pages = list(tiff.pages(io.BytesIO(tiff.encode([p, p], packing, two_dimensional=two, **layout))))
            assert len(pages) == 2 and all(np.array_equal(x.image(), p) for x in pages)
    # a Big file by hand: two planes of 8 bits in separate strips, most significant byte first, and a directory that points to itself
    a, b, c = (RNG.integers(0, 256, (2, 3)).astype(np.uint8) for _ in range(3))
    body = a.tobytes() + b.tobytes() + c.tobytes()
    tags = [(256, 3, [3]), (257, 3, [2]), (258, 3, [8, 8, 8]), (259, 3, [1]), (262, 3, [2]), (273, 3, [16, 22, 28]), (277, 3, [3]), (278, 3, [2]), (279, 3, [6, 6, 6]), (284, 3, [2])]
    at = 16 + len(body)
    entries = b"".join(struct.pack(">HHQ", t, k, len(v)) + struct.pack(f">{len(v)}H", *v).ljust(8, b"\0") for t, k, v in tags)
    data = b"MM" + struct.pack(">HHHQ", 43, 8, 0, at) + body + struct.pack(">Q", len(tags)) + entries + struct.pack(">Q", at)
    (page,) = tiff.pages(io.BytesIO(data))
    assert np.array_equal(page.image(), np.stack([a, b, c], 2).astype(int) * 257)


def test_tiff_parts_are_read_alone():
    p = raster(40, 40, 3, True)

    class Counting(io.BytesIO):
        most = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.most = max(Counting.most, len(out))
            return out

    (page,) = tiff.pages(Counting(tiff.encode([p], tiff.PLAIN, tile=16)))
    whole = np.zeros_like(p)
    for x, y, v in page.parts():
        whole[y : y + v.shape[0], x : x + v.shape[1]] = v
    assert np.array_equal(whole, p) and Counting.most == 16 * 16 * 3 * 2


def test_lzw():
    for n in (0, 1, 2, 300, 5000, 60_000):
        for top in (2, 256):
            data = bytes(RNG.integers(0, top, n).astype(np.uint8))
            assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_canvases_blend_and_dispose():
    f = lambda v, x, dispose, blend, alpha=65535: {"pixels": np.array([[[v, v, v, alpha]]]), "x": x, "y": 0, "dispose": dispose, "blend": blend}
    steps = [f(100, 0, "none", False), f(7, 0, "previous", True, 0), f(9, 1, "background", True), f(50, 0, "previous", True, 32768), f(3, 5, "none", True)]
    got = [c[0, :, 0].tolist() for c, _ in sequences.composed(steps, 2, 1)]
    assert got == [[100, 0], [100, 0], [100, 9], [75, 0], [100, 0]]


# --- the data source ----------------------------------------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(image_files.ImageFrames)
    a, b = smooth(6, 5), raster(6, 5)
    files = {"a.gif": sequences.WRITERS["gif"]([a, a[::-1].copy()], [50, 70]), "b.png": sequences.apng_encode([a, b, a], [10, 20, 30]), "c.webp": webp.encode_sequence([b, a]), "d.tif": tiff.encode([a, b, a, b], tile=16), "e.png": codecs.codec("png")[1](a), "f.jpg": b"\xff\xd8broken", "_g.png": b"hidden", "h.webp": base64.b64decode(LOSSY)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path), {"a.gif": [a, a[::-1]], "b.png": [a, b, a], "c.webp": [b, a], "d.tif": [a, b, a, b], "e.png": [a]}


def test_batch(spark, folder):
    path, want = folder
    rows = spark.read.format("image_frames").load(path).collect()
    got = {}
    for r in sorted((r for r in rows if not r.error), key=lambda r: r.frame):
        got.setdefault(os.path.basename(r.path), []).append(np.frombuffer(r.data, "<u2").reshape(r.height, r.width, r.channels)[:, :, :3])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(np.array_equal(x, y) for k in want for x, y in zip(got[k], want[k], strict=True))
    assert {os.path.basename(r.path) for r in rows if r.error} == {"f.jpg", "h.webp"}
    assert sorted(r.delay_ms for r in rows if r.path.endswith("b.png") and r.frame is not None) == [10, 20, 30]
    narrow = spark.read.format("image_frames").schema("path string, frame int, width int").option("splitBytes", 100).load(path)
    assert narrow.columns == ["path", "frame", "width"] and narrow.where("path like '%d.tif'").count() == 4 and narrow.rdd.getNumPartitions() > 5
    parts = spark.read.format("image_frames").option("parts", True).load(f"{path}/d.tif")
    assert parts.count() == 4 and parts.where("width = 5 and height = 6").count() == 4
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("image_frames").option("pushFilters", True).load(path).where("frame >= 1 and frame < 3")
        assert sorted((os.path.basename(r.path), r.frame) for r in some.collect()) == [("a.gif", 1), ("b.png", 1), ("b.png", 2), ("c.webp", 1), ("d.tif", 1), ("d.tif", 2)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    through = image_files.frames_of(spark.read.format("binaryFile").load(f"{path}/*.png"), ["path", "frame", "data"])
    assert through.columns == ["path", "frame", "data"] and through.count() == 4


def test_data_is_not_decoded_without_its_column(monkeypatch):
    monkeypatch.setattr(tiff.Page, "image", None)
    data = tiff.encode([raster(3, 4)])
    (batch,) = image_files.rows_of("x.tif", io.BytesIO(data), ["frame", "width", "height"], False)
    assert batch.to_pylist() == [{"frame": 0, "width": 4, "height": 3}]


def test_sink_and_stream(spark, tmp_path):
    spark.dataSource.register(image_files.ImageFrames)
    into, state = f"file://{tmp_path}/out", f"{tmp_path}/state"
    encode = codecs.codec("png")[1]
    rows = [(f"{k}.png", bytearray(encode(smooth(4, 3 + k)))) for k in range(5)]
    spark.createDataFrame(rows[:3], "name string, content binary").repartition(2).write.format("image_frames").mode("append").save(into)
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["0.png", "1.png", "2.png"]

    def run():
        stream = spark.readStream.format("image_frames").schema("path string, width int").option("filesPerBatch", 2).load(into)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/seen").option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.width for r in spark.read.schema("path string, width int").parquet(f"{tmp_path}/seen").collect())

    assert run() == [3, 4, 5]
    spark.createDataFrame(rows[3:], "name string, content binary").write.format("image_frames").mode("append").save(into)
    assert run() == [3, 4, 5, 6, 7] and run() == [3, 4, 5, 6, 7]
    with pytest.raises(Exception, match="name"):
        spark.createDataFrame([("../x", bytearray(b"y"))], "name string, content binary").write.format("image_frames").mode("append").save(into)
    assert not [n for n in os.listdir(f"{tmp_path}/out") if n.startswith("_")]


def test_many_small_files_are_shared_out():
    """Their decoding takes long whatever few bytes they have: partitions grow in number with the files, not in files."""
    small = [(f"{k}.webp", 3000, 0) for k in range(2000)]
    found = image_files.planned(small, image_files.SPLIT_BYTES)
    assert len(found) > 40 and max(len(f.paths) for f in found) <= 40
    assert [p for f in found for p in f.paths] == [p for p, _, _ in small]


def test_kept_columns_follow_the_pixels(spark):
    rows = spark.createDataFrame([(1, 2, 1, bytearray([1, 0, 2, 0]), 30, "a"), (2, 1, 1, bytearray([3, 0]), None, None)], "image_id long, width int, channels int, data binary, delay_ms int, name string")
    got = codecs.to_pixels(rows, ["delay_ms", "name"])
    assert got.columns == ["image_id", "y", "x", "r", "g", "b", "a", "delay_ms", "name"]
    assert sorted((r.image_id, r.x, r.r, r.delay_ms, r.name) for r in got.collect()) == [(1, 0, 1, 30, "a"), (1, 1, 2, 30, "a"), (2, 0, 3, None, None)]


def test_sequences_are_decoded_once(spark, sf):
    from pixelweave import catalog_images

    plan = catalog_images._sequence("webp")(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan
