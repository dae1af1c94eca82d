"""Small cases of the findings of round 4; each failed before its change."""

import numpy as np
from pyspark.sql import functions as F

from pixelweave import catalog, catalog_images
from pixelweave.functions import point
from pixelweave.operators import attention, compare, frames, geometry, kernels, neighbourhood, stitching


def test_a_bent_view_near_wrong_matches_does_not_beat_the_exact_one():
    # the last three are wrong; a bent view has 19 matches within three pixels, one more than the exact one
    src = [(84, 136), (84, 126), (107, 125), (82, 37), (81, 58), (61, 38), (88, 36), (83, 31), (61, 58), (32, 35), (73, 46), (61, 32), (132, 112), (73, 50), (69, 46), (69, 50), (107, 139), (56, 59), (34, 152), (37, 58), (26, 143)]
    dst = [(67, 123), (67, 113), (90, 112), (65, 24), (64, 45), (44, 25), (71, 23), (66, 18), (44, 45), (15, 22), (56, 33), (44, 19), (115, 99), (56, 37), (52, 33), (52, 37), (90, 126), (39, 46), (17, 146), (140, 90), (148, 154)]
    h, inliers = stitching.estimate(np.array(src, float), np.array(dst, float))
    assert np.abs(h - [1, 0, -17, 0, 1, -13, 0, 0]).max() < 1e-6 and inliers.tolist() == [True] * 18 + [False] * 3


def test_stitch_shuffles_stored_images_only(spark, sf):
    # the views, the panorama and its measures are made in the row of the pair: no third join, of panoramas
    plan = catalog.queries()["stitch"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_views_made_where_the_pair_is_are_those_made_before(spark, sf):
    images = catalog_images._images(spark, sf).where("image_id < 3").localCheckpoint()
    other = images.withColumn("image_id", F.col("image_id") + (1 << 40))
    pairs = catalog_images._view_pairs(images)
    first, second = catalog_images._VIEWS
    want = stitching.stitch(pairs, frames.apply(images, first).unionByName(frames.apply(other, second)))
    got = stitching.stitch(pairs, images.unionByName(other), views=(first, second), beside=True)
    assert sorted(want.collect()) == sorted(got.select(*frames.COLUMNS).collect())
    assert sorted(got.selectExpr("image_id", "o_width", "o_height", "o_channels", "o_data").collect()) == sorted(images.collect())


def colours(spark, values):
    """One row of pixels."""
    return spark.createDataFrame([(0, 0, x, *v, None) for x, v in enumerate(values)], "image_id long, y int, x int, r int, g int, b int, a int")


def rgb(df):
    return [(r.r, r.g, r.b) for r in df.orderBy("x").collect()]


def test_halves_of_demosaiced_values_go_up(spark):
    p = np.full((8, 8, 1), 31795, np.int64)
    p[:, 2::4] = 31796
    image = frames._row(0, p).to_pylist()
    out = np.frombuffer(frames.demosaic(spark.createDataFrame([tuple(image[0].values())], frames.SCHEMA)).collect()[0].data, "<u2").reshape(8, 8, 3)
    assert (out[::2, 1::2, 0] == 31796).all()


def test_sepia_of_an_exact_half_goes_up(spark):
    # in tenths of thousandths, as the SQL's decimals: 37936.5, 31363.5 and 38352.5
    found = rgb(point.sepia(colours(spark, [(32661, 33142, 29768), (32028, 31679, 35633), (29239, 29682, 33410)]), 0.8))
    assert found == [(41691, 37937, 30339), (41352, 37453, 31364), (38353, 34880, 29226)]


def test_range_threshold_sums_luma_in_doubles(spark):
    found = rgb(point.range_threshold(colours(spark, [(33033, 34866, 33659), (32326, 29513, 35355), (34239, 30006, 30278)]), 0.45, 0.48, 0.52, 0.55))
    assert found == [(62130,) * 3, (50977,) * 3, (60397,) * 3]


def test_red_of_anaglyphs_is_a_luma_in_doubles(spark):
    left = colours(spark, [(35933, 29377, 29831), (29102, 32904, 30411), (31603, 31049, 32210)])
    assert [r for r, _, _ in rgb(compare.anaglyph(left, left))] == [31388, 31482, 31346]


def test_pixels_are_sorted_by_luma_in_doubles(spark):
    # 29281.925 both, but the second one's sum in doubles is the smaller
    found = rgb(geometry.sort_pixels(colours(spark, [(29428, 29211, 29264), (29225, 29120, 30265)])))
    assert found == [(29225, 29120, 30265), (29428, 29211, 29264)]


def test_a_whole_deviation_is_not_cut_to_the_next_lower(spark):
    # 81 times the variances are the squares of 9 * 3080 and 9 * 3452
    windows = [[29159, 32922, 34295, 38173, 33722, 28835, 35744, 36646, 30828], [28913, 37562, 33604, 32937, 30651, 37724, 33665, 29194, 27560]]
    df = spark.createDataFrame([(k, i // 3, i % 3, v, v, v, None) for k, w in enumerate(windows) for i, v in enumerate(w)], "image_id long, y int, x int, r int, g int, b int, a int")
    found = neighbourhood.statistic(df, "standarddeviation", 1).where("y = 1 and x = 1").orderBy("image_id").collect()
    assert [(r.r, r.g, r.b) for r in found] == [(3080,) * 3, (3452,) * 3]


def test_oil_paint_bins_luma_from_left_to_right(spark):
    # the first luma is 19.5 of 255, in doubles a little less: bin 19 as the second, where that bin first counts two
    edge, low = (13356, 2046, 9816), (4883, 4883, 4883)
    assert rgb(kernels.oil_paint(colours(spark, [edge, low]), 1))[0] == low


def test_a_colour_at_the_threshold_is_no_foreground():
    # four times 41150 less the corners' sum is 39321, which is 4 * 0.15 * 65535
    p = np.full((8, 8, 3), 31320, np.uint16)
    p[0, 0, 0], p[0, 7, 0], p[7, 0, 0], p[7, 7, 0] = 27025, 27621, 35676, 34957
    p[2:6, 2:6, 0] = 41151
    p[2:6, 0, 0] = 41150
    assert attention.foreground(p) == (2, 2, 6, 6)
