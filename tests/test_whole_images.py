"""Operators on whole images against slow versions: cuts, mattes, fills, stitching, palettes, textures, stacks and layers."""

import itertools
import math
import time

import numpy as np
import pytest

from pixelweave.functions.blend import composite
from pixelweave.operators import attention, frames, layer_trees, palettes, retouch, selection, stacks, stitching, textures
from pixelweave.sources import codecs

M = 65535


def random(seed, h=9, w=11, c=3):
    return np.random.default_rng(seed).integers(0, M + 1, (h, w, c))


def images(spark, arrays, start=0):
    rows = [(start + k, p.shape[1], p.shape[0], p.shape[2], bytearray(p.astype("<u2").tobytes())) for k, p in enumerate(arrays)]
    return spark.createDataFrame(rows, frames.SCHEMA)


def arrays(df):
    return {r.image_id: np.frombuffer(bytes(r.data), "<u2").reshape(r.height, r.width, r.channels).astype(int) for r in df.collect()}


# --- windows and crops --------------------------------------------------------------------------------------------------------------


def test_window_sums():
    v = random(1)[..., 0]
    for radius in (0, 1, 3, 20):
        total, n = attention.window_sums(v, radius)
        for y, x in itertools.product(range(9), range(11)):
            part = v[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1]
            assert total[y, x] == part.sum() and n[y, x] == part.size


def test_smart_crop_finds_the_object(spark):
    p = np.full((60, 80, 3), 60000)
    p[20:40, 50:70] = random(2, 20, 20)
    (region,) = attention.regions(images(spark, [p]), 24, 24).collect()
    assert 44 <= region.x <= 52 and 14 <= region.y <= 22
    got = arrays(attention.smart_crop(images(spark, [p, p[:10, :10]]), 24, 24))
    assert np.array_equal(got[0], p[region.y : region.y + 24, region.x : region.x + 24]) and np.array_equal(got[1], p[:10, :10])
    flat = attention.best_region(np.full((9, 9, 3), 7), 4, 4)
    assert flat[2:] == (4, 4) and 0 <= flat[0] <= 5 and 0 <= flat[1] <= 5


# --- cuts and mattes ----------------------------------------------------------------------------------------------------------------


def test_minimum_cut_equals_brute_force_on_4_by_4():
    sides = ((np.arange(1 << 16)[:, None] >> np.arange(16)) & 1).astype(bool).reshape(-1, 4, 4)
    rng = np.random.default_rng(3)
    for trial in range(24):
        source, sink, right, below = (rng.integers(0, (3, 10, 1000, 1 << 40)[trial % 4], s) for s in ((4, 4), (4, 4), (4, 3), (3, 4)))
        cost = lambda f, s=source, t=sink, r=right, b=below: (s * ~f).sum((-1, -2)) + (t * f).sum((-1, -2)) + (r * (f[..., 1:] != f[..., :-1])).sum((-1, -2)) + (b * (f[..., 1:, :] != f[..., :-1, :])).sum((-1, -2))
        assert cost(selection.minimum_cut(source, sink, right, below)) == cost(sides).min()


def test_grab_cut_costs_on_4_by_4_are_minimal():
    """The whole round on small images: costs of the library's mixtures, and no labelling that keeps what is known is cheaper."""
    sides = ((np.arange(1 << 16)[:, None] >> np.arange(16)) & 1).astype(bool).reshape(-1, 4, 4)
    for seed in range(6):
        p, t = random(seed, 4, 4), np.full((4, 4, 1), M // 2)
        t[0, 0], t[3, 3] = 0, M
        source, sink, right, below = selection.cut_costs(p, selection.known(t), selection.known(t) != 0, 2)
        cost = lambda f, s=source, k=sink, r=right, b=below: (s * ~f).sum((-1, -2)) + (k * f).sum((-1, -2)) + (r * (f[..., 1:] != f[..., :-1])).sum((-1, -2)) + (b * (f[..., 1:, :] != f[..., :-1, :])).sum((-1, -2))
        got = selection.minimum_cut(source, sink, right, below)
        assert cost(got) == cost(sides).min() and not got[0, 0] and got[3, 3]


def test_grab_cut_and_background(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 8000, (40, 50, 3))
    p[10:30, 15:40] += 45000
    t = np.full((40, 50, 1), M // 2)
    t[:3] = t[-3:] = t[:, :3] = t[:, -3:] = 0
    t[18:22, 25:30] = M
    want = np.zeros((40, 50), bool)
    want[10:30, 15:40] = True
    assert np.array_equal(arrays(selection.grab_cut(images(spark, [p]), images(spark, [t])))[0][..., 0] > 0, want)
    none = arrays(selection.grab_cut(images(spark, [p]), images(spark, [np.zeros((40, 50, 1), int)])))[0]
    assert not none.any()
    for f in (selection.alpha_matting, selection.knn_matting):
        a = arrays(f(images(spark, [p]), images(spark, [t])))[0][..., 0]
        assert a[12:28, 17:38].mean() > 0.85 * M and a[~want].mean() < 0.1 * M
    out = arrays(selection.remove_background(images(spark, [p]), 0.3, 0.1))[0]
    assert out.shape == (40, 50, 4) and np.array_equal(out[..., :3], p) and out[15:25, 20:35, 3].mean() > out[:5, :, 3].mean()


def test_relative_matte_by_pixel():
    p, t = random(6, 6, 7), np.full((6, 7, 1), M // 2)
    t[0], t[5] = 0, M
    got = selection.relative_matte(p, t, 3, 4.0, block=8)
    labels = selection.known(t)
    for y, x in itertools.product(range(1, 5), range(7)):
        side = []
        for label in (1, 0):
            d = sorted(sum(((int(a) - int(b)) / M) ** 2 for a, b in zip(p[y, x], p[v, u])) + ((v - y) ** 2 + (u - x) ** 2) / 16 * 0.1 for v in range(6) for u in range(7) if labels[v, u] == label)[:3]
            w = [math.exp(-v / 32) for v in d]
            side.append(sum(a * b for a, b in zip(w, d)) / sum(w))
        assert got[y, x] == pytest.approx(side[1] / sum(side), abs=1e-9)


def test_solved_matte_solves_its_system():
    p, t = random(7, 8, 9), np.full((8, 9, 1), M // 2)
    t[:2], t[6:] = 0, M
    i, j, a = selection.affinities(p, 4, 2)
    v = p.reshape(-1, 3) / M
    for pixel in range(72):
        y, x = divmod(pixel, 9)
        far = sorted((((v[pixel] - v[q]) ** 2).sum() + 0.01 * ((q // 9 - y) ** 2 + (q % 9 - x) ** 2) / 4, q) for q in range(72) if q != pixel and abs(q // 9 - y) <= 2 and abs(q % 9 - x) <= 2)
        assert sorted(j[i == pixel]) == sorted(q for _, q in far[:4])
    w = np.zeros((72, 72))
    np.add.at(w, (i, j), a)
    w = w + w.T
    fixed = np.where(selection.known(t).reshape(-1) == 2, 0, 100.0)
    want = np.linalg.solve(np.diag(w.sum(1) + fixed + 1e-9) - w, fixed * (selection.known(t).reshape(-1) == 1) + 0.5e-9)
    assert np.abs(selection.solved_matte(p, t, 4, 2).reshape(-1) - np.clip(want, 0, 1)).max() < 1e-4


# --- fills --------------------------------------------------------------------------------------------------------------------------


def slow_fill(p, hole, radius):
    h, w = hole.shape
    out, done = p.astype(int).copy(), ~hole
    far = {(y, x): 1 for y in range(h) for x in range(w) if hole[y, x] and any(0 <= y + a < h and 0 <= x + b < w and not hole[y + a, x + b] for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)))}
    layer = sorted(far)
    while layer:
        following = []
        for y, x in layer:
            if done[y, x]:
                continue
            near = [(v, u, 1 / ((v - y) ** 2 + (u - x) ** 2)) for v in range(h) for u in range(w) if done[v, u] and 0 < (v - y) ** 2 + (u - x) ** 2 <= radius * radius]
            if near:
                out[y, x] = [min(int(sum(out[v, u, c] * k for v, u, k in near) / sum(k for *_, k in near) + 0.5), M) for c in range(p.shape[2])]
            done[y, x] = True
            for v in range(max(y - 1, 0), min(y + 2, h)):
                for u in range(max(x - 1, 0), min(x + 2, w)):
                    if not done[v, u] and far.get((v, u), 1 << 30) > far[y, x] + 1:
                        far[v, u] = far[y, x] + 1
                        following.append((v, u))
        layer = following
    return out


@pytest.mark.parametrize("seed", range(5))
def test_fill_from_edge(seed):
    p = random(seed, 12, 13)
    hole = np.random.default_rng(seed).random((12, 13)) < (0.1, 0.5, 0.9, 0.0, 1.0)[seed]
    hole[4:9, 5:10] |= seed < 3
    got = retouch.fill_from_edge(p, hole, 3)
    assert np.abs(got - slow_fill(p, hole, 3)).max() <= 1 and np.array_equal(got[~hole], p[~hole])


def test_fill_along_edges_by_pixel():
    p, hole = random(8), np.zeros((9, 11), bool)
    hole[2:7, 3:9] = True
    want = retouch.fill_from_edge(p, hole, 2)
    for _ in range(4):
        new = want.copy()
        for y, x, c in itertools.product(range(1, 8), range(1, 10), range(3)):
            if hole[y, x]:
                n, s, e, w, v = (int(want[a, b, c]) for a, b in ((y - 1, x), (y + 1, x), (y, x + 1), (y, x - 1), (y, x)))
                slope = math.hypot((e - w) / 2, (s - n) / 2)
                new[y, x, c] = int(min(max(v + 0.25 * (n + s + e + w - 4 * v) * (1 / (1 + slope) if slope > 0.001 else 1) + 0.5, 0), M))
        want = new
    assert np.abs(retouch.fill_along_edges(p, hole, 2, 4) - want).max() <= 1


def test_patches_restore_a_repeating_picture(spark):
    """A pattern of period 6 loses a part: every pixel comes back from a place a whole number of periods away."""
    p = np.tile(random(9, 6, 6), (8, 8, 1))
    hole = np.zeros((48, 48, 1), int)
    hole[20:27, 18:26] = M
    got = arrays(retouch.patch_fill(images(spark, [p]), images(spark, [hole]), 7, 8))[0]
    assert (got == p).all(2).mean() > 0.995 and np.array_equal(got[hole[..., 0] == 0], p[hole[..., 0] == 0])
    again = arrays(retouch.patch_fill(images(spark, [p]), images(spark, [hole]), 7, 8))[0]
    assert np.array_equal(got, again)
    assert np.array_equal(retouch.fill_with_patches(p, np.ones((48, 48), bool)), p)


# --- stitching ----------------------------------------------------------------------------------------------------------------------


def scene(seed=1, h=240, w=320):
    rng = np.random.default_rng(seed)
    p = np.zeros((h, w, 3), int)
    for _ in range(700):
        y, x, s = rng.integers(0, h), rng.integers(0, w), rng.integers(4, 22)
        p[y : y + s, x : x + s] = rng.integers(0, M, 3)
    return p


def test_matches_are_the_nearest_and_clear():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64) for n in (70, 50))
    b[7], b[8], b[20] = a[3], a[3], a[66] ^ np.uint64(5)
    want = []
    for i in range(70):
        d = [sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a[i], v)) for v in b]
        j = d.index(min(d))
        second = min(d[:j] + d[j + 1 :])
        if second > 0 and d[j] / second < 0.75:
            want.append((i, j, d[j]))
    assert stitching.match(a, b).tolist() == [list(w) for w in want] and (66, 20, 8) in want


def test_homography_is_recovered_among_outliers():
    h = np.array([1.1, 0.05, -30, -0.03, 0.95, 12, 2e-4, -1e-4])
    rng = np.random.default_rng(4)
    src = rng.random((200, 2)) * 300
    dst = stitching.project(h, src)
    dst[:80] += np.abs(rng.normal(0, 60, (80, 2))) + 10  # farther than an inlier may be
    found, inliers = stitching.estimate(src, dst)
    assert np.abs(found - h).max() < 1e-6 and inliers[80:].all() and inliers.sum() < 130
    assert np.array_equal(stitching.estimate(src[:3], dst[:3])[0], stitching.IDENTITY)
    same, agreed = stitching.estimate(np.ones((9, 2)), np.ones((9, 2)))
    assert np.isfinite(same).all() and not agreed.any()


def test_shifted_and_turned_views(spark):
    p = scene()
    a, b = p[10:190, 5:215], p[40:220, 70:280]
    h = np.array([0.96, -0.12, 25.0, 0.1, 1.02, -8.0, 1e-4, -5e-5])
    yy, xx = np.mgrid[0:180, 0:210]
    at = stitching.project(h, np.stack([xx.ravel(), yy.ravel()], 1).astype(float)).reshape(180, 210, 2)
    x0, y0 = np.clip(at[..., 0].astype(int), 0, 318), np.clip(at[..., 1].astype(int), 0, 238)
    fx, fy = np.clip(at[..., 0] - x0, 0, 1)[..., None], np.clip(at[..., 1] - y0, 0, 1)[..., None]
    turned = (p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx) * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy
    found = stitching.features(images(spark, [a, b, turned.astype(int), p, np.zeros((50, 50, 3), int)]))
    pairs = spark.createDataFrame([(0, 1), (2, 3), (0, 4)], "a long, b long")
    rows = {r.a * 10 + r.b: r for r in stitching.align(pairs, found, 0.8).collect()}
    assert np.abs(np.array(rows[1].homography) - [1, 0, -65, 0, 1, -30, 0, 0]).max() < 1e-2
    corners = np.array([[20.0, 20], [190, 20], [190, 160], [20, 160]])
    assert np.abs(stitching.project(np.array(rows[23].homography), corners) - stitching.project(h, corners)).max() < 1.0
    assert rows[4].matches == 0 and rows[4].homography == stitching.IDENTITY.tolist()
    out = arrays(stitching.stitch(pairs.where("b != 3"), images(spark, [a, b, a, a, np.zeros((50, 50, 3), int)])))
    assert {k: v.shape for k, v in out.items()}[0] in ((210, 275, 3), (180, 210, 3))


def test_bands():
    a, b = random(11, 33, 41), random(12, 33, 41)
    for share, want in ((np.ones((33, 41)), a), (np.zeros((33, 41)), b)):
        assert np.abs(stitching.blend_bands(a, b, share, 4) - want).max() < 1e-6
    assert np.abs(stitching.blend_bands(a, a, np.random.default_rng(0).random((33, 41)), 5) - a).max() < 1e-6


# --- palettes and textures ----------------------------------------------------------------------------------------------------------


def test_nearest_colours_by_tree_are_the_nearest():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 256):
        palette = rng.integers(0, 256, (n, 3)).astype(np.uint8)
        palette[-1] = palette[0]
        colors = np.concatenate([rng.integers(0, 256, (3000, 3)), palette])
        assert np.array_equal(palettes.Nearest(palette)(colors), ((colors[:, None].astype(int) - palette[None].astype(int)) ** 2).sum(2).argmin(1))


def test_dithering_by_pixel():
    p, palette = random(13, 10, 7, 4), np.random.default_rng(7).integers(0, 256, (6, 3)).astype(np.uint8)
    v = codecs._bytes(p[..., :3]).astype(np.float32)
    want = np.zeros((10, 7, 3), int)
    for y in range(10):
        for x in range(7):
            c = np.clip(v[y, x] + np.float32(0.5), 0, 255).astype(np.uint8)
            k = ((c.astype(int) - palette.astype(int)) ** 2).sum(1).argmin()
            want[y, x] = palette[k]
            lost = v[y, x] - palette[k]
            for dy, dx, s in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if y + dy < 10 and 0 <= x + dx < 7:
                    v[y + dy, x + dx] += lost * np.float32(s / 16)
    got = palettes.mapped(p, palette, True)
    assert (got[..., :3] == want * 257).all(2).mean() > 0.97 and np.array_equal(got[..., 3], p[..., 3])


def test_median_cut_and_octree(spark):
    colors = np.repeat(np.array([[0, 0, 0], [255, 0, 0], [0, 0, 250], [9, 9, 9]], np.uint8), [5, 5, 5, 5], 0)
    assert sorted(palettes.median_cut(colors, 4).tolist()) == [[0, 0, 0], [0, 0, 250], [9, 9, 9], [255, 0, 0]]
    assert len(palettes.median_cut(colors, 99)) == 4 and palettes.median_cut(colors, 1).tolist() == [[66, 2, 64]]
    some = [random(k, 20, 20) for k in range(4)]
    for most in (1, 5, 64):
        palette = palettes.shared_palette(images(spark, some), most)
        assert 1 <= len(palette) <= most
    few = [np.full((3, 3, 3), 257 * 10), np.full((2, 5, 3), 257 * 200)]
    assert palettes.shared_palette(images(spark, few), 2).tolist() == [[10] * 3, [200] * 3]
    out = arrays(palettes.quantize(images(spark, some), 16))
    assert all(len(np.unique(v.reshape(-1, 3), axis=0)) <= 16 for v in out.values())


def test_synthesis(spark):
    p = np.tile(np.array([[[0] * 3, [M] * 3], [[M] * 3, [0] * 3]]), (6, 6, 1))
    out = arrays(textures.synthesize(images(spark, [p, random(1, 8, 8)]), 20, 17, 2, None))
    board = out[0][..., 0] > 0
    assert np.array_equal(board[1:] ^ board[:-1], np.ones((16, 20), bool)) and np.array_equal(board[:, 1:] ^ board[:, :-1], np.ones((17, 19), bool))
    colors = {tuple(c) for c in random(1, 8, 8).reshape(-1, 3).tolist()}
    assert {tuple(c) for c in out[1].reshape(-1, 3).tolist()} <= colors and out[1].shape == (17, 20, 3)
    assert np.array_equal(arrays(textures.synthesize(images(spark, [p, random(1, 8, 8)]), 20, 17, 2, None).where("image_id = 1"))[1], out[1])


# --- stacks and layers --------------------------------------------------------------------------------------------------------------


def test_stacks_fold_in_order(spark):
    flat = [np.full((6, 6, 3), v) for v in (1000, 30000, 64000)]
    df = images(spark, flat + [random(1, 6, 6)]).selectExpr("*", "if(image_id < 3, 5, 6) seq_id", "int(-image_id) z", "double(image_id) - 1 stops")
    fused = arrays(stacks.exposure_fusion(df.repartition(4)))
    assert abs(fused[5] - 30000).max() < 3000 and np.array_equal(fused[6], random(1, 6, 6))
    assert set(arrays(stacks.hdr_merge(df, "stops"))) == {5, 6}
    sharp, soft = random(2, 12, 12), np.full((12, 12, 3), 30000)
    left = np.where(np.arange(12)[None, :, None] < 6, sharp, soft)
    right = np.where(np.arange(12)[None, :, None] < 6, soft, sharp)
    both = images(spark, [left, right]).selectExpr("*", "0 seq_id", "int(image_id) z")
    got = arrays(stacks.focus_stack(both))[0]
    assert np.array_equal(got[3:9, 2:4], sharp[3:9, 2:4]) and np.array_equal(got[3:9, 8:10], sharp[3:9, 8:10])
    with pytest.raises(Exception, match="different sizes"):
        stacks.exposure_fusion(images(spark, [sharp, flat[0]]).selectExpr("*", "0 seq_id", "int(image_id) z")).collect()


@pytest.mark.parametrize("mode", sorted([*layer_trees.MIXED, *layer_trees.COVERED]))
def test_layer_modes_are_those_of_pixel_tables(spark, mode):
    base, over = random(20, 5, 5, 4), random(21, 5, 5, 4)
    base[0, 0, 3] = over[1, 1, 3] = 0
    want = composite(codecs.to_pixels(images(spark, [base])), codecs.to_pixels(images(spark, [over])), mode).collect()
    got = layer_trees.blended(base, over, mode)
    assert all(np.abs(got[r.y, r.x] - [r.r, r.g, r.b, r.a]).max() <= 1 for r in want)


def test_layer_table_changes(spark):
    rows = [(1, z, 0, "layer", 10 + z, None, None, None, None, None, None, None, None) for z in range(4)]
    layers = spark.createDataFrame(rows, layer_trees.LAYERS)
    order = lambda df: [r.image_id for r in df.orderBy("z").collect()]
    assert order(layer_trees.removed(layers, 1)) == [10, 12, 13]
    assert order(layer_trees.moved(layers, 0, 2)) == [11, 12, 10, 13] and order(layer_trees.moved(layers, 3, 0)) == [13, 10, 11, 12] and order(layer_trees.moved(layers, 1, 1)) == [10, 11, 12, 13]
    new = spark.createDataFrame([(1, 0, 0, "layer", 99, None, None, None, None, None, None, None, None)], layer_trees.LAYERS)
    assert order(layer_trees.inserted(layers, 2, new)) == [10, 11, 99, 12, 13] and order(layer_trees.inserted(layers, 0, new))[0] == 99
    hidden = arrays(layer_trees.flatten(layers, images(spark, []), 3, 2))[1]
    assert hidden.shape == (2, 3, 4) and not hidden.any()


def test_nested_groups(spark):
    red, blue = np.zeros((4, 4, 4), int) + [M, 0, 0, M], np.zeros((2, 2, 4), int) + [0, 0, M, M]
    mask = np.full((4, 4, 1), M)
    mask[:, :2] = 0
    rows = [(7, 0, 0, "layer", 0, None), (7, 1, 0, "group", None, None), (7, 2, 1, "group", None, 2), (7, 3, 2, "layer", 1, None), (7, 4, 1, "layer", 1, None)]
    places = {3: (1, 1), 4: (3, 3)}
    full = [(*r, None, None, None, None, *places.get(r[1], (None, None)), None) for r in rows]
    got = arrays(layer_trees.flatten(spark.createDataFrame(full, layer_trees.LAYERS), images(spark, [red, blue, mask]), 4, 4))[7]
    want = np.zeros((4, 4), int)
    want[1:3, 2] = want[3, 3] = 1
    assert np.array_equal(got[..., 2] == M, want == 1) and np.array_equal(got[..., 0] == M, want == 0)


# --- creative -----------------------------------------------------------------------------------------------------------------------


def test_deskew_straightens_lines(spark):
    from pixelweave.operators import creative

    page = np.full((120, 160, 3), M)
    for top in range(20, 100, 12):
        page[top : top + 4, 20:140] = 0
    tilted = creative.turned(page - M, 4.0).astype(int) + M  # white all around
    assert creative.skew(page) == pytest.approx(0, abs=0.11) or abs(creative.skew(page)) < 0.2
    angle = creative.skew(tilted)
    assert abs(abs(angle) - 4.0) < 0.35
    back = arrays(creative.deskew(images(spark, [tilted])))[0]
    inner = back[back.shape[0] // 2 - 30 : back.shape[0] // 2 + 30, back.shape[1] // 2 - 40 : back.shape[1] // 2 + 40, 0]
    assert abs(creative.skew(np.repeat(inner[..., None], 3, 2))) < 0.6
    assert creative.skew(np.full((9, 9, 3), M)) == 0.0


def test_shear_moves_rows():
    from pixelweave.operators import creative

    p = random(30, 6, 5)
    assert np.array_equal(creative.sheared(p, 0.0), p)
    out = creative.sheared(p, 1.0)
    assert out.shape == (6, 11, 3)
    for y in range(6):
        assert np.array_equal(out[y, 3 + y - 3 : 3 + y - 3 + 5], p[y])
    soft = creative.sheared(np.full((4, 4, 3), 40000), 0.25)
    assert soft.shape == (4, 5, 3) and soft.max() <= 40000


def test_patches_are_compared_at_all_places_together(monkeypatch):
    """The costs of patches, as a sum over their places one by one gives them, in less than two thirds of its time."""
    rng = np.random.default_rng(4)

    def one_by_one(f, now, at, of):
        h, w = f.hole.shape
        total, n = np.zeros(len(of)), np.zeros(len(of))
        for dy in range(-f.half, f.half + 1):
            for dx in range(-f.half, f.half + 1):
                sy, sx = f.y[of] + dy, f.x[of] + dx
                ok = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
                d = now[sy[ok], sx[ok]] - f.p[at[ok, 0] + dy, at[ok, 1] + dx]
                total[ok] += (d * d).sum(1)
                n[ok] += 1
        return total / np.maximum(n, 1)

    def seconds(f):
        found = []
        for _ in range(5):
            start = time.perf_counter()
            for _ in range(40):
                f()
            found.append(time.perf_counter() - start)
        return min(found)

    for side, size, compared in ((8, 3, 1 << 16), (8, 3, 10), (20, 9, 1 << 16), (20, 5, 100)):
        monkeypatch.setattr(retouch, "COMPARED", compared)
        p = rng.integers(0, 65536, (side, side, 3)).astype("<u2")
        hole = rng.random((side, side)) < 0.3
        f = retouch.PatchField(p, hole, size, 1)
        now, of = p.astype(np.float32), np.arange(len(f.y))
        assert f.ok and (f.cost(now, f.at, of) == one_by_one(f, now, f.at, of)).all()
        if side == 8 and compared > 10:
            assert seconds(lambda: f.cost(now, f.at, of)) < seconds(lambda: one_by_one(f, now, f.at, of)) * 2 / 3  # noqa: B023
