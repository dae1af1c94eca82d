"""Connected regions: components, flood fill, distance transforms, lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantum import M, luma

KEY = ["image_id", "y", "x"]


def _label(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Component numbers from 1 in raster order of their first pixel; union-find over runs of pixels."""
    h, w = mask.shape
    parent = np.arange(h * w)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    steps = [(0, -1), (-1, 0)] + ([(-1, -1), (-1, 1)] if connectivity == 8 else [])
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy, dx in steps:
            if 0 <= y + dy and 0 <= x + dx < w and mask[y + dy, x + dx]:
                a, b = find(y * w + x), find((y + dy) * w + x + dx)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) if m else -1 for i, m in enumerate(mask.reshape(-1))])
    _, number = np.unique(roots[roots >= 0], return_inverse=True)
    out = np.zeros(h * w, np.int32)
    out[roots >= 0] = number + 1
    return out.reshape(h, w)


def label(df: DataFrame, threshold: float = 0.5, connectivity: int = 8) -> DataFrame:
    """image_id, y, x, label (0: background), l (luma 0..1). An image is one group; images are spread over tasks."""
    import pandas as pd

    rows = df.select(*KEY, (luma() / float(M)).alias("l"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), bool)
        mask[pdf.y, pdf.x] = pdf.l >= threshold
        return pdf.assign(label=_label(mask, connectivity)[pdf.y, pdf.x])

    return rows.groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, l double, label int")


def components(df: DataFrame, threshold: float = 0.5, connectivity: int = 8) -> DataFrame:
    """Area, box, centre and mean luma of each component."""
    rows = label(df, threshold, connectivity).where("label > 0")
    return rows.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("l").alias("mean_intensity"))


def flood_select(df: DataFrame, x: int, y: int, fuzz: float, connectivity: int = 4) -> DataFrame:
    """A mask of the pixels joined to the seed whose colour is within the fuzz of the seed's."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        value = np.zeros((h, w, 3))
        value[pdf.y, pdf.x] = pdf[["r", "g", "b"]]
        if not (0 <= x < w and 0 <= y < h):
            return pd.DataFrame({"image_id": pdf.image_id, "y": pdf.y, "x": pdf.x, "v": 0})
        near = ((value - value[y, x]) ** 2).sum(axis=2) <= fuzz * fuzz
        numbers = _label(near, connectivity)
        return pd.DataFrame({"image_id": pdf.image_id, "y": pdf.y, "x": pdf.x, "v": np.where(numbers == numbers[y, x], M, 0)[pdf.y, pdf.x]})

    return df.select(*KEY, "r", "g", "b").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, v int")


def distance_transform(df: DataFrame, metric: str = "euclidean", threshold: float = 0.5) -> DataFrame:
    """Two-pass chamfer distance to the background, scaled to the image's largest."""
    import pandas as pd

    side, corner = {"euclidean": (1.0, math.sqrt(2.0)), "manhattan": (1.0, 2.0), "chebyshev": (1.0, 1.0)}[metric]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        d = np.zeros((h, w))
        d[pdf.y, pdf.x] = np.where(pdf.l >= threshold, np.inf, 0.0)
        for ys, xs, taps in ((range(h), range(w), ((0, -1, side), (-1, 0, side), (-1, -1, corner), (-1, 1, corner))), (range(h - 1, -1, -1), range(w - 1, -1, -1), ((0, 1, side), (1, 0, side), (1, 1, corner), (1, -1, corner)))):
            for yy in ys:
                for xx in xs:
                    if d[yy, xx]:
                        d[yy, xx] = min([d[yy, xx], *(d[yy + a, xx + b] + c for a, b, c in taps if 0 <= yy + a < h and 0 <= xx + b < w)])
        d = np.where(np.isinf(d), max(h, w), d)
        top = d.max()
        return pd.DataFrame({"image_id": pdf.image_id, "y": pdf.y, "x": pdf.x, "v": np.floor((d / top if top else d) * M + 0.5).astype(int)[pdf.y, pdf.x]})

    return df.select(*KEY, (luma() / float(M)).alias("l")).groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, v int")


def hough(edges: DataFrame, size: tuple[int, int], threshold: int = 100, resolution: float = 1.0) -> DataFrame:
    """image_id, rho, theta (steps), votes: lines that at least ``threshold`` white pixels vote for, most votes first.

    Each edge pixel votes once for every angle: a fixed number of rows a pixel, summed before the shuffle.
    """
    w, h = size
    n = math.ceil(180 / resolution)
    reach = math.sqrt(w * w + h * h)
    angles = F.array(*[F.struct(F.lit(k).alias("theta"), F.lit(math.cos(k * math.pi / n)).alias("c"), F.lit(math.sin(k * math.pi / n)).alias("s")) for k in range(n)])
    votes = edges.where(F.col("v") >= M // 2).select("image_id", F.explode(angles).alias("t"), "x", "y")
    rho = F.bround(F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s") + reach).cast("int")
    return votes.groupBy("image_id", rho.alias("rho"), F.col("t.theta").alias("theta")).agg(F.count("*").alias("votes")).where(F.col("votes") >= threshold)


def harris(df: DataFrame, k: float = 0.04, quality: float = 0.01, most: int = 500) -> DataFrame:
    """image_id, y, x, response of corners: strict local maxima above a share of the image's greatest."""
    from .neighbourhood import neighbours, sobel, square

    g = sobel(df).select(*KEY, (F.col("gx") / M).alias("gx"), (F.col("gy") / M).alias("gy"))
    g = g.select(*KEY, (F.col("gx") * F.col("gx")).alias("xx"), (F.col("gx") * F.col("gy")).alias("xy"), (F.col("gy") * F.col("gy")).alias("yy"))
    sums = neighbours(g, square(1), ("xx", "xy", "yy"), edges="ignore").groupBy(*KEY).agg(F.sum("nxx").alias("a"), F.sum("nxy").alias("b"), F.sum("nyy").alias("c"))
    r = sums.select(*KEY, F.round(F.col("a") * F.col("c") - F.col("b") * F.col("b") - (F.col("a") + F.col("c")) ** 2 * k, 9).alias("response"))
    top = r.groupBy("image_id").agg((F.max("response") * quality).alias("least"))
    others = [o for o in square(3) if o != (0, 0)]
    peak = neighbours(r, others, ("response",), edges="ignore").groupBy(*KEY).agg(F.max("nresponse").alias("near"))
    found = r.join(peak, KEY).join(top, "image_id").where((F.col("response") > F.col("near")) & (F.col("response") > F.col("least")))
    order = Window.partitionBy("image_id").orderBy(F.desc("response"), "y", "x")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(*KEY, "response")
