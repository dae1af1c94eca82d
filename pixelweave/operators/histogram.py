"""Image statistics, histograms and what is mapped through them: stretches, equalisation, thresholds, tone maps.

Image-level results are aggregates by image, joined back to the pixels by image_id; histograms have 256 bins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantum import M, clamp, from_unit, luma, q16, t16, to_byte
from ..sources.rasters import to_long

RGB = ("r", "g", "b")


def histogram(long: DataFrame) -> DataFrame:
    """image_id, c, bin, n over the exact 8-bit map of channel values."""
    return long.groupBy("image_id", "c", to_byte("v").alias("bin")).agg(F.count("*").alias("n"))


def luma_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id", F.floor(luma() / float(M) * 255 + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame, *by: str) -> DataFrame:
    so_far = Window.partitionBy("image_id", *by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("cum", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy("image_id", *by)))


def statistics(long: DataFrame) -> DataFrame:
    """image_id, c: n, min, max, mean, sample deviation and variance, skewness, excess kurtosis, entropy (bits), median (of bins)."""
    u = F.col("v") / float(M)
    flat = F.min("v") == F.max("v")
    basic = long.groupBy("image_id", "c").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg(u).alias("mean"), F.stddev_samp(u).alias("stddev"), F.var_samp(u).alias("variance"), F.when(flat, 0.0).otherwise(F.skewness(u)).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis(u)).alias("kurtosis"))
    p = F.col("n") / F.col("total")
    bins = cumulative(histogram(long), "c").groupBy("image_id", "c").agg((-F.sum(p * F.log2(p))).alias("entropy"), (F.min(F.when(F.col("cum") >= F.floor(F.col("total") / 2), F.col("bin"))) / 255.0).alias("median"))
    return basic.join(bins, ["image_id", "c"])


def normalize(df: DataFrame) -> DataFrame:
    """One minimum and maximum over all colours of an image; a flat image stays."""
    ends = df.groupBy("image_id").agg(F.min(F.least(*RGB)).alias("lo"), F.max(F.greatest(*RGB)).alias("hi"))
    rows = df.join(ends, "image_id")
    value = lambda c: F.when(F.col("hi") > F.col("lo"), q16((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")) * float(M))).otherwise(F.col(c))
    return rows.withColumns({c: value(c) for c in RGB}).drop("lo", "hi")


def auto_level(df: DataFrame) -> DataFrame:
    """The same for each channel alone."""
    ends = df.groupBy("image_id").agg(*[f(c).alias(f"{n}{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))])
    rows = df.join(ends, "image_id")
    value = lambda c: F.when(F.col(f"hi{c}") > F.col(f"lo{c}"), q16((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) * float(M))).otherwise(F.col(c))
    return rows.withColumns({c: value(c) for c in RGB}).select(*df.columns)


def auto_gamma(df: DataFrame) -> DataFrame:
    """Each channel to a mean of one half: gamma = ln .5 / ln mean. A value that is the mean becomes a half, which goes up."""
    means = df.groupBy("image_id").agg(*[(F.avg(c) / float(M)).alias(f"m{c}") for c in RGB])
    rows = df.join(means, "image_id")

    def value(c: str):
        ok = (F.col(f"m{c}") > 0) & (F.col(f"m{c}") < 1)
        power = math.log(0.5) / F.log(F.when(ok, F.col(f"m{c}")).otherwise(0.5))
        return F.when(ok, q16(F.round(F.pow(F.col(c) / float(M), power) * float(M), 9))).otherwise(F.col(c))

    return rows.withColumns({c: value(c) for c in RGB}).select(*df.columns)


def white_balance(df: DataFrame) -> DataFrame:
    """Gray world: each channel scaled to the mean of the channels' means."""
    means = df.groupBy("image_id").agg(*[F.avg(c).alias(f"m{c}") for c in RGB])
    all_ = (F.col("mr") + F.col("mg") + F.col("mb")) / 3
    rows = df.join(means, "image_id")
    return rows.withColumns({c: F.when(F.col(f"m{c}") > 0, q16(F.col(c) * (all_ / F.col(f"m{c}")))).otherwise(F.col(c)) for c in RGB}).select(*df.columns)


def equalize(long: DataFrame) -> DataFrame:
    """Through the channel's cumulative histogram: image_id, y, x, c, v. The table of bins joins back by image, channel and bin."""
    cdf = cumulative(histogram(long), "c").withColumn("least", F.min("cum").over(Window.partitionBy("image_id", "c")))
    span = F.when(F.col("total") > F.col("least"), F.col("total") - F.col("least")).otherwise(1)
    table = cdf.select("image_id", "c", "bin", F.floor(clamp((F.col("cum") - F.col("least")) / span * float(M)) + 0.5).cast("int").alias("to"))
    return long.withColumn("bin", to_byte("v")).join(table, ["image_id", "c", "bin"]).select("image_id", "y", "x", "c", F.col("to").alias("v"))


def contrast_stretch(long: DataFrame, black: float = 0.15, white: float = 0.05) -> DataFrame:
    """[t] Clip the tails (percent of a channel's pixels) on the full-depth histogram, then stretch."""
    full = cumulative(long.groupBy("image_id", "c", F.col("v").alias("bin")).agg(F.count("*").alias("n")), "c")
    above = F.col("total") - F.col("cum") + F.col("n")
    ends = full.groupBy("image_id", "c").agg(F.min(F.when(F.col("cum") > F.col("total") * (black / 100), F.col("bin"))).alias("lo"), F.max(F.when(above > F.col("total") * (white / 100), F.col("bin"))).alias("hi"))
    value = F.when(F.col("hi") > F.col("lo"), t16((F.col("v") - F.col("lo")) * float(M) / (F.col("hi") - F.col("lo")))).otherwise(F.col("v"))
    return long.join(ends, ["image_id", "c"]).select("image_id", "y", "x", "c", value.alias("v"))


def otsu(df: DataFrame) -> DataFrame:
    """image_id, bin, threshold: the first bin of greatest between-class variance of the luma histogram."""
    h = cumulative(luma_histogram(df))
    so_far, whole = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("image_id")
    h = h.withColumn("s", F.sum(F.col("bin") * F.col("n")).over(so_far)).withColumn("all", F.sum(F.col("bin") * F.col("n")).over(whole))
    w0, w1 = F.col("cum"), F.col("total") - F.col("cum")
    d = F.col("s") / w0 - (F.col("all") - F.col("s")) / F.when(w1 > 0, w1).otherwise(1)
    scored = h.where("cum < total").select("image_id", "bin", (w0.cast("double") * w1 * d * d).alias("between"))
    best = scored.groupBy("image_id").agg(F.max(F.struct("between", (-F.col("bin")).alias("m"))).alias("t"))
    return df.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce(-F.col("t.m"), F.lit(0)).alias("bin"), (F.coalesce(-F.col("t.m"), F.lit(0)) / 255.0).alias("threshold"))


def apply_otsu(df: DataFrame) -> DataFrame:
    rows = df.join(otsu(df), "image_id")
    v = F.when(luma() / float(M) >= F.col("threshold"), M).otherwise(0)
    return rows.withColumns(dict.fromkeys(RGB, v)).select(*df.columns)


def kapur(df: DataFrame) -> DataFrame:
    """image_id, bin: the first bin of greatest summed entropy of both classes, from running sums of p ln p."""
    h = cumulative(luma_histogram(df)).withColumn("p", F.col("n") / F.col("total"))
    so_far, whole = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("image_id")
    e = F.col("p") * F.log("p")
    h = h.withColumn("e0", F.sum(e).over(so_far)).withColumn("e", F.sum(e).over(whole)).where("cum < total")
    w0 = F.col("cum") / F.col("total")
    value = F.log(w0) - F.col("e0") / w0 + F.log(1 - w0) - (F.col("e") - F.col("e0")) / (1 - w0)
    return h.select("image_id", "bin", F.round(value, 9).alias("h")).groupBy("image_id").agg((-F.max(F.struct("h", (-F.col("bin")).alias("m")))["m"]).alias("bin"))


def unique_colors(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg(F.count_distinct("r", "g", "b").alias("colors"))


def unique_colors_image(df: DataFrame) -> DataFrame:
    """Distinct colours in order of their first pixel, as one row of pixels."""
    firsts = df.groupBy("image_id", "r", "g", "b").agg(F.min(F.struct("y", "x")).alias("at"))
    order = Window.partitionBy("image_id").orderBy("at")
    return firsts.select("image_id", F.lit(0).alias("y"), (F.row_number().over(order) - 1).alias("x"), "r", "g", "b")


def reinhard(df: DataFrame, key: float = 0.18, saturation: float = 1.0) -> DataFrame:
    """[t] Global tone map by the image's log-average luminance; less than full saturation goes towards the mapped luminance."""
    lum = luma() / float(M)
    means = df.groupBy("image_id").agg(F.exp(F.avg(F.log(lum + 1e-6))).alias("mean_log"))
    rows = df.join(means, "image_id")
    scaled = lum * (F.lit(key) / F.col("mean_log"))
    mapped = scaled / (scaled + 1)
    ratio = F.when(lum > 1e-6, mapped / F.when(lum > 1e-6, lum).otherwise(1.0)).otherwise(0.0)
    power = lambda v, p: v if p == 1 else F.pow(v, F.lit(float(p)))
    out = lambda c: power(F.col(c) / float(M) * ratio, saturation) * (F.lit(1.0) if saturation == 1 else power(mapped, 1 - saturation))
    return rows.withColumns({c: t16(F.round(out(c) * float(M), 6)) for c in RGB}).select(*df.columns)


def drago(df: DataFrame, bias: float = 0.85) -> DataFrame:
    """[t] Adaptive logarithmic map by the image's greatest luminance."""
    lum = luma() / float(M)
    rows = df.join(df.groupBy("image_id").agg(F.max(lum).alias("top")), "image_id")
    adapted = F.log10(F.pow(lum / (F.col("top") + 1e-6), F.lit(math.log(bias) / math.log(0.5))) * 8 + 2)
    below = F.log10(F.col("top") + 1) * adapted
    mapped = F.least(F.greatest(F.log10(lum + 1) / F.when(below > 0, below).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    ratio = F.when(lum > 1e-6, mapped / F.when(lum > 1e-6, lum).otherwise(1.0)).otherwise(0.0)
    return rows.withColumns({c: t16(F.round(F.col(c) / float(M) * ratio * float(M), 6)) for c in RGB}).select(*df.columns)


def color_transfer(df: DataFrame, reference: DataFrame, strength: float = 1.0) -> DataFrame:
    """[t] Each channel's mean and deviation to those of a reference image (the one image of ``reference``)."""
    stats = lambda d, p: d.agg(*[f(c).alias(f"{p}{n}{c}") for c in RGB for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    own = df.groupBy("image_id").agg(*[f(c).alias(f"p{n}{c}") for c in RGB for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = stats(reference, "q").first().asDict()
    rows = df.join(own, "image_id")
    value = lambda c: (F.col(c) - F.col(f"pm{c}")) / F.when(F.col(f"ps{c}") > 0, F.col(f"ps{c}")).otherwise(1.0) * one[f"qs{c}"] + one[f"qm{c}"]
    return rows.withColumns({c: t16(F.round(F.col(c) + (value(c) - F.col(c)) * strength, 6)) for c in RGB}).select(*df.columns)


def match_histogram(long: DataFrame, reference: DataFrame) -> DataFrame:
    """Each channel's cumulative shares to the reference image's: the first reference bin whose share is no less.

    Both tables of bins have at most 256 rows a channel; the nearest bin comes from a range window, not a join of pairs.
    """
    own = cumulative(histogram(long), "c").select("image_id", "c", "bin", (F.col("cum") / F.col("total")).alias("p"))
    ref = cumulative(histogram(reference), "c").select("c", F.col("bin").alias("to"), (F.col("cum") / F.col("total")).alias("p"))
    images = own.select("image_id", "c").distinct()
    both = own.select("image_id", "c", "bin", F.lit(None).cast("int").alias("to"), "p", F.lit(0).alias("kind")).unionByName(images.join(F.broadcast(ref), "c").select("image_id", "c", F.lit(None).cast("int").alias("bin"), "to", "p", F.lit(1).alias("kind")))
    after = Window.partitionBy("image_id", "c").orderBy("p", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = both.withColumn("to", F.coalesce(F.min("to").over(after), F.lit(255))).where("kind = 0").select("image_id", "c", "bin", "to")
    return long.withColumn("bin", to_byte("v")).join(table, ["image_id", "c", "bin"]).select("image_id", "y", "x", "c", (F.col("to") * 257).cast("int").alias("v"))


def pixel_channels(df: DataFrame) -> DataFrame:
    return to_long(df)


def triangle(df: DataFrame) -> DataFrame:
    """image_id, bin, threshold: the first bin of the luma histogram farthest from the chord of its peak and its longer tail."""
    dense = luma_histogram(df).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    dense = dense.select("image_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double")).alias("n"))
    dense = dense.withColumns({"peak": F.array_position("n", F.array_max("n")).cast("int") - 1, "used": F.filter(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get("n", i) > 0)})
    low, high = F.element_at("used", 1), F.element_at("used", -1)
    right = (F.col("peak") - low) < (high - F.col("peak"))
    ends = dense.select("image_id", "n", F.when(right, F.col("peak")).otherwise(low).alias("from"), F.when(right, high).otherwise(F.col("peak")).alias("to"))
    x0, x1 = F.col("from"), F.col("to")
    y0, y1 = F.get("n", x0), F.get("n", x1)
    far = ends.select("image_id", x0.alias("from"), F.transform(F.sequence(x0, x1), lambda i: F.round(F.abs((y1 - y0) * i - (x1 - x0) * F.get("n", i) + x1 * y0 - y1 * x0), 6)).alias("far"))
    best = F.when(F.array_max("far") > 0, F.col("from") + F.array_position("far", F.array_max("far")).cast("int") - 1).otherwise(F.col("from"))
    return far.select("image_id", best.alias("bin"), F.when(F.size("far") == 1, 0.5).otherwise(best / 255.0).alias("threshold"))


def linear_stretch(df: DataFrame, black: float = 2.0, white: float = 1.0) -> DataFrame:
    """One pair of levels for all channels: those where so many percent of the luma values lie at or below, and at or above."""
    level = F.floor(F.col("r") * 0.212656 + F.col("g") * 0.715158 + F.col("b") * 0.072186).cast("int")
    h = df.groupBy("image_id", level.alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumns({"below": F.sum("n").over(up), "total": F.sum("n").over(Window.partitionBy("image_id"))})
    above = F.col("total") - F.col("below") + F.col("n")
    ends = h.groupBy("image_id").agg(F.min(F.when(F.col("below") >= F.col("total") * (black / 100), F.col("bin"))).alias("lo"), F.max(F.when(above >= F.col("total") * (white / 100), F.col("bin"))).alias("hi"))
    v = lambda c: F.when(F.col(c) <= F.col("lo"), 0).when(F.col(c) >= F.col("hi"), M).otherwise(F.floor((F.col(c) - F.col("lo")) * (float(M) / (F.col("hi") - F.col("lo")))).cast("int"))
    return df.join(ends, "image_id").withColumns({c: v(c) for c in RGB}).select(*df.columns)


def hu_moments(df: DataFrame) -> DataFrame:
    """image_id, hu1 to hu7: the seven moments of luma that turns, scales and shifts leave unchanged; one aggregate an image."""
    v, x, y = luma() / float(M), F.col("x").cast("double"), F.col("y").cast("double")
    m = df.groupBy("image_id").agg(*[F.sum(F.pow(x, F.lit(p)) * F.pow(y, F.lit(q)) * v).alias(f"m{p}{q}") for p in range(4) for q in range(4) if p + q <= 3])
    c = lambda name: F.col(f"m{name}")
    xc, yc = c("10") / c("00"), c("01") / c("00")
    two, three = c("00") * c("00"), F.pow(c("00"), F.lit(2.5))
    n20, n11, n02 = (c("20") - xc * c("10")) / two, (c("11") - xc * c("01")) / two, (c("02") - yc * c("01")) / two
    n30 = (c("30") - xc * c("20") * 3 + xc * xc * c("10") * 2) / three
    n21 = (c("21") - xc * c("11") * 2 - yc * c("20") + xc * xc * c("01") * 2) / three
    n12 = (c("12") - yc * c("11") * 2 - xc * c("02") + yc * yc * c("10") * 2) / three
    n03 = (c("03") - yc * c("02") * 3 + yc * yc * c("01") * 2) / three
    a, b, s, t = n30 + n12, n21 + n03, n30 - n12 * 3, n21 * 3 - n03
    hu = [n20 + n02, (n20 - n02) * (n20 - n02) + n11 * n11 * 4, s * s + t * t, a * a + b * b, s * a * (a * a - b * b * 3) + t * b * (a * a * 3 - b * b), (n20 - n02) * (a * a - b * b) + n11 * a * b * 4, t * a * (a * a - b * b * 3) - s * b * (a * a * 3 - b * b)]
    return m.select("image_id", *[F.when(c("00") == 0, 0.0).otherwise(e).alias(f"hu{k}") for k, e in enumerate(hu, 1)])
