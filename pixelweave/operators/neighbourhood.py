"""Neighbourhood operators: separable sums as windows, other kernels as a spread of each pixel to its neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantum import M, luma

RGBA = ("r", "g", "b", "a")
KEY = ["image_id", "y", "x"]


def gaussian_weights(sigma: float) -> list[float]:
    radius = max(1, math.ceil(3 * sigma))
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _along(df: DataFrame, axis: str, weights: Sequence[float], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Weighted sums along an axis with edge replication: whole lines as windows, lags and leads of each pixel; ``keep`` stays."""
    line = Window.partitionBy("image_id", "x" if axis == "y" else "y").orderBy(axis)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    radius = len(weights) // 2

    def value(c: str) -> Column:
        out = None
        for k, w in zip(range(-radius, radius + 1), weights, strict=True):
            v = F.col(c) if k == 0 else F.coalesce(F.lag(c, -k).over(line), F.first(c).over(whole)) if k < 0 else F.coalesce(F.lead(c, k).over(line), F.last(c).over(whole))
            out = v * w if out is None else out + v * w
        return out

    return df.select(*KEY, *keep, *[value(c).alias(c) for c in names])


def round16(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.least(F.greatest(F.round(c, 6), F.lit(0.0)), F.lit(float(M))) + 0.5).cast("int")


def separable(df: DataFrame, weights: Sequence[float], names: Sequence[str] = RGBA, keep: Sequence[str] = ()) -> DataFrame:
    """A rank-one kernel in two passes, rounded once; alpha is blurred too."""
    out = _along(_along(df, "x", weights, names, keep), "y", weights, names, keep)
    return out.select(*KEY, *keep, *[round16(c).alias(c) for c in names])


def with_blur(df: DataFrame, sigma: float) -> DataFrame:
    """``df`` with its Gaussian blur beside it as sr, sg, sb: the image passes through the same two windows, without a join."""
    own = df.select(*KEY, *RGBA, *[F.col(c).alias(f"s{c}") for c in "rgb"])
    return separable(own, gaussian_weights(sigma), ("sr", "sg", "sb"), RGBA)


def gaussian_blur(df: DataFrame, sigma: float) -> DataFrame:
    return separable(df, gaussian_weights(sigma))


def box_blur(df: DataFrame, radius: int) -> DataFrame:
    n = 2 * radius + 1
    return separable(df, [1.0 / n] * n)


def sharpen(df: DataFrame, sigma: float, amount: float = 1.0) -> DataFrame:
    return with_blur(df, sigma).select(*KEY, *[round16(F.col(c) + (F.col(c) - F.col(f"s{c}")) * amount).alias(c) for c in "rgb"], "a")


def unsharp_mask(df: DataFrame, sigma: float, amount: float = 1.0, threshold: float = 0.0) -> DataFrame:
    """[t] As sharpen, but only where twice the difference reaches the threshold."""
    d = lambda c: F.col(c) - F.col(f"s{c}")
    value = lambda c: F.when(F.abs(d(c) * 2) < threshold * M, F.col(c)).otherwise(F.floor(F.least(F.greatest(F.col(c) + d(c) * amount, F.lit(0.0)), F.lit(float(M))))).cast("int")
    return with_blur(df, sigma).select(*KEY, *[value(c).alias(c) for c in "rgb"], "a")


def rows_as_arrays(df: DataFrame, names: Sequence[str] = RGBA) -> DataFrame:
    """image_id, w, h and one array a channel in raster order: the form for windows that are not separable.

    One row an image: for images of bounded size (tile larger ones first, see ``tiles``).
    """
    cells = df.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", *names))).alias("p"))
    return cells.select("image_id", "w", "h", *[F.col(f"p.{c}").alias(c) for c in names])


def neighbours(df: DataFrame, offsets: Sequence[tuple], names: Sequence[str] = RGBA, edges: str = "clamp") -> DataFrame:
    """For every pixel one row per offset (dx, dy, *values): columns k (the offset's number), n{c} (the neighbour's channels).

    ``clamp`` repeats edge pixels, ``ignore`` leaves outside neighbours out. Neighbours are looked up in the image's arrays
    next to the pixel, so only one shuffle by image is needed, whatever the number of offsets.
    """
    arrays = rows_as_arrays(df, names)
    flat = arrays.select("image_id", "w", "h", *[F.col(c).alias(f"all_{c}") for c in names], F.explode(F.sequence(F.lit(0), (F.col("w") * F.col("h") - 1).cast("int"))).alias("i"))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(int(o[0])).alias("dx"), F.lit(int(o[1])).alias("dy")) for k, o in enumerate(offsets)])
    spread = flat.withColumns({"y": F.floor(F.col("i") / F.col("w")).cast("int"), "x": (F.col("i") % F.col("w")).cast("int")}).withColumn("o", F.explode(table))
    nx, ny = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy")
    if edges == "ignore":
        spread = spread.where((nx >= 0) & (nx < F.col("w")) & (ny >= 0) & (ny < F.col("h")))
    else:
        nx, ny = F.least(F.greatest(nx, F.lit(0)), F.col("w") - 1), F.least(F.greatest(ny, F.lit(0)), F.col("h") - 1)
    at = (ny * F.col("w") + nx + 1).cast("int")
    return spread.select(*KEY, F.col("o.k").alias("k"), *[F.element_at(F.col(f"all_{c}"), at).alias(f"n{c}") for c in names])


def convolve(df: DataFrame, kernel: Sequence[Sequence[float]], bias: float = 0.0) -> DataFrame:
    """Any odd kernel, edges clamped, not normalised, alpha included."""
    half_y, half_x = len(kernel) // 2, len(kernel[0]) // 2
    offsets = [(dx - half_x, dy - half_y, w) for dy, row in enumerate(kernel) for dx, w in enumerate(row) if w]
    weights = F.array(*[F.lit(float(o[2])) for o in offsets])
    near = neighbours(df, offsets).withColumn("wt", F.element_at(weights, F.col("k") + 1))
    return near.groupBy(*KEY).agg(*[round16(F.sum(F.col(f"n{c}") * F.col("wt")) + bias).alias(c) for c in RGBA])


def edge_detect(df: DataFrame, radius: float = 1.0) -> DataFrame:
    n = max(3, 2 * math.ceil(radius) + 1)
    kernel = [[-1.0] * n for _ in range(n)]
    kernel[n // 2][n // 2] = n * n - 1.0
    return convolve(df, kernel)


#: The emboss kernel.
EMBOSS = [[-2, -1, 0], [-1, 1, 1], [0, 1, 2]]


def emboss(df: DataFrame) -> DataFrame:
    return convolve(df, EMBOSS)


def sobel(df: DataFrame) -> DataFrame:
    """Gradient magnitude of luma: image_id, y, x, gx, gy, magnitude."""
    gx, gy = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
    offsets = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    near = neighbours(df.select(*KEY, F.floor(luma() + 0.5).cast("int").alias("l")), offsets, ("l",))
    at = lambda k: F.element_at(F.array(*[F.lit(float(k[dy + 1][dx + 1])) for dx, dy in offsets]), F.col("k") + 1)
    sums = near.groupBy(*KEY).agg(F.sum(F.col("nl") * at(gx)).alias("gx"), F.sum(F.col("nl") * at(gy)).alias("gy"))
    return sums.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def square(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def element(shape: str, radius: int) -> list[tuple[int, int]]:
    """Offsets of a structuring element: square, diamond, disk, cross or plus."""
    ok = {"square": lambda x, y: True, "diamond": lambda x, y: abs(x) + abs(y) <= radius, "disk": lambda x, y: x * x + y * y <= radius * radius, "cross": lambda x, y: not x or not y, "plus": lambda x, y: not x or not y}[shape]
    return [(x, y) for x, y in square(radius) if ok(x, y)]


def statistic(df: DataFrame, kind: str, radius: int = 1) -> DataFrame:
    """[t] minimum, maximum, mean, median, mode, rootmeansquare, standarddeviation, gradient, contrast or nonpeak of a window."""
    near = neighbours(df, square(radius))

    def value(c: str) -> Column:
        v = F.col(f"n{c}")
        low, high = F.min(v), F.max(v)
        if kind == "mode":
            return F.expr(f"array_sort(collect_list(n{c}))")
        if kind == "nonpeak":
            return F.expr(f"array_sort(collect_list(n{c}))")
        return {
            "minimum": low,
            "maximum": high,
            "mean": F.floor(F.sum(v) / F.count(v)),
            "median": F.element_at(F.array_sort(F.collect_list(v)), (F.floor(F.count(v) / 2) + 1).cast("int")),
            "rootmeansquare": F.floor(F.sqrt(F.avg(v.cast("double") * v))),
            # n² times the variance is a whole number
            "standarddeviation": F.floor(F.sqrt(F.count(v) * F.sum(v.cast("long") * v) - F.sum(v) * F.sum(v)) / F.count(v)),
            "gradient": high - low,
            "contrast": F.when(high + low > 0, F.floor((high - low) * float(M) / (high + low))).otherwise(0),
        }[kind]

    out = near.groupBy(*KEY).agg(*[value(c).alias(c) for c in RGBA])
    if kind == "mode":
        # the smallest of the most frequent values: the values are sorted, counts compare first
        best = lambda c: F.array_max(F.transform(F.array_distinct(c), lambda v: F.struct(F.size(F.filter(c, lambda w: w == v)).alias("n"), (-v).alias("m"))))
        out = out.select(*KEY, *[(-best(F.col(c))["m"]).alias(c) for c in RGBA])
    if kind == "nonpeak":
        inner = lambda c: F.filter(c, lambda v: (v != F.array_min(c)) & (v != F.array_max(c)))
        mean = lambda c: F.when(F.size(inner(c)) > 0, F.floor(F.aggregate(inner(c), F.lit(0).cast("long"), lambda s, v: s + v) / F.size(inner(c)))).otherwise(F.floor((F.array_min(c) + F.array_max(c)) / 2))
        out = out.select(*KEY, *[mean(F.col(c)).alias(c) for c in RGBA])
    return out.select(*KEY, *[F.col(c).cast("int").alias(c) for c in RGBA])


def median_filter(df: DataFrame, radius: int = 1) -> DataFrame:
    return statistic(df, "median", radius)


def mode_filter(df: DataFrame, radius: int = 1) -> DataFrame:
    return statistic(df, "mode", radius)


def erode(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Least value below the element; places outside the image don't count."""
    return neighbours(df, offsets, edges="ignore").groupBy(*KEY).agg(*[F.min(f"n{c}").alias(c) for c in RGBA])


def dilate(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return neighbours(df, offsets, edges="ignore").groupBy(*KEY).agg(*[F.max(f"n{c}").alias(c) for c in RGBA])


def opening(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return dilate(erode(df, offsets), offsets)


def closing(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return erode(dilate(df, offsets), offsets)


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(*KEY, *[F.col(c).alias(f"o{c}") for c in "rgb"])
    return a.join(right, KEY).select(*KEY, *[F.greatest(F.lit(0), F.col(c) - F.col(f"o{c}")).alias(c) for c in "rgb"], "a")


def gradient(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    near = neighbours(df, offsets, edges="ignore")
    return near.groupBy(*KEY).agg(*[(F.max(f"n{c}") - F.min(f"n{c}")).alias(c) for c in "rgb"], F.max("na").alias("a"))


def top_hat(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return _minus(df, opening(df, offsets))


def bottom_hat(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    return _minus(closing(df, offsets), df)


def adaptive_threshold(df: DataFrame, window: int = 3, offset: float = 0.0) -> DataFrame:
    """``attention.adaptive_threshold`` on a table of pixels: images are gathered once, and nothing is joined."""
    from ..sources.codecs import to_pixels
    from . import attention, frames

    return to_pixels(attention.adaptive_threshold(frames.from_pixels(df), window, offset))


def pixelate(df: DataFrame, size: int) -> DataFrame:
    """[t] Block means, joined back."""
    block = [F.floor(F.col("y") / size).alias("by"), F.floor(F.col("x") / size).alias("bx")]
    means = df.groupBy("image_id", *block).agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(f"m{c}") for c in "rgb"])
    rows = df.withColumns({"by": F.floor(F.col("y") / size), "bx": F.floor(F.col("x") / size)}).join(means, ["image_id", "by", "bx"])
    return rows.select(*KEY, *[F.col(f"m{c}").alias(c) for c in "rgb"], "a")


def frequency_separation(df: DataFrame, sigma: float) -> tuple[DataFrame, DataFrame]:
    """Low frequencies, and what is left plus the middle value."""
    low, both = gaussian_blur(df, sigma), with_blur(df, sigma)
    high = both.select(*KEY, *[F.least(F.greatest(F.col(c) - F.col(f"s{c}") + 32767, F.lit(0)), F.lit(M)).alias(c) for c in "rgb"], "a")
    return low, high


def normal_map(df: DataFrame) -> DataFrame:
    """Surface normals of the first channel as a height map."""
    gray = df.select(*KEY, *[F.col("r").alias(c) for c in "rgb"], "a")
    g = sobel(gray)
    nx, ny = -F.col("gx") / float(M), -F.col("gy") / float(M)
    length = F.sqrt(nx * nx + ny * ny + 1)
    return g.select(*KEY, *[F.floor((n / length + 1) / 2 * M + 0.5).cast("int").alias(c) for n, c in ((nx, "r"), (ny, "g"), (F.lit(1.0), "b"))])


def local_contrast(df: DataFrame, radius: int = 10, strength: float = 50.0) -> DataFrame:
    """[t] Each pixel's distance from a triangular mean of the luma around it grows by a percentage; colours keep their ratio."""
    n = [radius + 1 - abs(k) for k in range(-radius, radius + 1)]
    weights = [w / sum(n) for w in n]
    own = df.select(*KEY, *RGBA, luma("601 double").alias("m"))
    mean = _along(_along(own, "x", weights, ("m",), RGBA), "y", weights, ("m",), RGBA)
    v = luma("601 double")
    gain = F.when(v > 1, (v + (v - F.col("m")) * (min(max(strength, 0), 100) / 100)) / v).otherwise(1.0)
    return mean.select(*KEY, *[F.floor(F.least(F.greatest(F.round(F.col(c) * gain, 6), F.lit(0.0)), F.lit(float(M)))).cast("int").alias(c) for c in "rgb"], "a")


def shade(df: DataFrame, azimuth: float = 30.0, elevation: float = 30.0, tinted: bool = False) -> DataFrame:
    """[t] Light from a direction on the surface whose height is the luma; ``tinted`` scales the image by it."""
    a, e = math.radians(azimuth), math.radians(elevation)
    light = [M * math.cos(a) * math.cos(e), M * math.sin(a) * math.cos(e), M * math.sin(e)]
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    own = df.select(*KEY, *RGBA, luma().alias("l"))
    side = lambda f, w: F.coalesce(f("l").over(w), F.col("l"))
    own = own.withColumn("nx", side(F.lag, row) - side(F.lead, row)).withColumn("ny", side(F.lag, column) - side(F.lead, column))
    nz = 2.0 * M
    dot = F.col("nx") * light[0] + F.col("ny") * light[1] + nz * light[2]
    value = F.when((F.abs("nx") < 0.5) & (F.abs("ny") < 0.5), light[2]).otherwise(dot / F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + nz * nz))
    value = F.least(F.greatest(F.round(value, 6), F.lit(0.0)), F.lit(float(M)))
    return own.select(*KEY, *[F.floor(F.round(F.col(c) * value / float(M), 6) if tinted else value).cast("int").alias(c) for c in "rgb"], "a")


def lens_blur(df: DataFrame, radius: int = 5) -> DataFrame:
    """The mean over a disc; what lies outside the image doesn't count."""
    disc = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]
    return neighbours(df, disc, edges="ignore").groupBy(*KEY).agg(*[round16(F.avg(f"n{c}")).alias(c) for c in RGBA])


def pointillize(df: DataFrame, radius: int = 4, spacing: int = 0, background: int = M) -> DataFrame:
    """Discs of the colours at grid places on a background; of discs that overlap the later one shows."""
    step = spacing or 2 * radius
    most = 2 * radius // step + 1
    near = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(most + 1) for i in range(most + 1)])
    at = lambda c, k: (F.floor(F.col(c) / step) - most + 1 + k) * step + radius
    asks = df.select(*KEY, F.explode(near).alias("o")).select(*KEY, at("y", F.col("o.j")).cast("int").alias("cy"), at("x", F.col("o.i")).cast("int").alias("cx"))
    asks = asks.where((F.col("cy") >= radius) & (F.col("cx") >= radius) & ((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) <= radius * radius))
    centres = df.where(((F.col("x") - radius) % step == 0) & ((F.col("y") - radius) % step == 0)).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), *[F.col(c).alias(f"d{c}") for c in "rgb"])
    last = asks.join(centres, ["image_id", "cy", "cx"]).groupBy(*KEY).agg(F.max(F.struct("cy", "cx", "dr", "dg", "db")).alias("d"))
    return df.select(*KEY, "a").join(last, KEY, "left").select(*KEY, *[F.coalesce(F.col(f"d.d{c}"), F.lit(background)).alias(c) for c in "rgb"], "a")
