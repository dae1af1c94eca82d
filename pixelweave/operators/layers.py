"""Sequences and layouts: append, montage, sprite sheets, frame replay, layer stacks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blend import composite
from ..functions.quantum import M
from .geometry import sizes

KEY = ["image_id", "y", "x"]


def _laid(df: DataFrame, places: DataFrame, image_id: int) -> DataFrame:
    """Pixels of all images on one canvas; ``places``: image_id, ox, oy."""
    return df.join(places, "image_id").select(F.lit(image_id).cast("long").alias("image_id"), (F.col("y") + F.col("oy")).cast("int").alias("y"), (F.col("x") + F.col("ox")).cast("int").alias("x"), "r", "g", "b", "a")


def append(df: DataFrame, horizontal: bool = True, by: str | None = None) -> DataFrame:
    """All images side by side, in order of image_id. ``by``: a grouping expression, a canvas for each group."""
    s = sizes(df).withColumn("part", F.expr(by) if by else F.lit(0))
    before = Window.partitionBy("part").orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("w" if horizontal else "h").over(before), F.lit(0))
    places = s.select("image_id", "part", (off if horizontal else F.lit(0)).alias("ox"), (F.lit(0) if horizontal else off).alias("oy"))
    return df.join(places, "image_id").select(F.col("part").cast("long").alias("image_id"), (F.col("y") + F.col("oy")).cast("int").alias("y"), (F.col("x") + F.col("ox")).cast("int").alias("x"), "r", "g", "b", "a")


def montage(df: DataFrame, count: int, columns: int | None = None, spacing: int = 0) -> DataFrame:
    """Row-major grid of the images in order of image_id; cells as large as the largest image."""
    columns = columns or math.ceil(math.sqrt(count))
    s = sizes(df)
    cell = s.agg(F.max("w").alias("cw"), F.max("h").alias("ch"))
    order = Window.orderBy("image_id")
    n = F.row_number().over(order) - 1
    first = cell.first()
    cw, ch = (first.cw or 0) + spacing, (first.ch or 0) + spacing
    places = s.withColumn("n", n).select("image_id", ((F.col("n") % columns) * cw + spacing).alias("ox"), (F.floor(F.col("n") / columns) * ch + spacing).alias("oy"))
    return _laid(df, places, 0)


def sprite_sheet(df: DataFrame, names: DataFrame, count: int, padding: int = 0) -> tuple[DataFrame, DataFrame]:
    """A grid atlas, and one row of JSON with name, x, y, width, height of each frame. ``names``: image_id, name."""
    columns = math.ceil(math.sqrt(count))
    s = sizes(df)
    top = s.agg(F.max("w").alias("w"), F.max("h").alias("h")).first()
    cw, ch = (top.w or 0) + 2 * padding, (top.h or 0) + 2 * padding
    n = F.row_number().over(Window.orderBy("image_id")) - 1
    places = s.withColumn("n", n).select("image_id", "w", "h", ((F.col("n") % columns) * cw + padding).alias("ox"), (F.floor(F.col("n") / columns) * ch + padding).alias("oy"))
    frames = places.join(names, "image_id").select(F.struct("image_id", "name", F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("w").alias("width"), F.col("h").alias("height")).alias("f"))
    text = frames.agg(F.to_json(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.struct(f["name"].alias("name"), f["x"].alias("x"), f["y"].alias("y"), f["width"].alias("width"), f["height"].alias("height")))).alias("json"))
    return _laid(df, places.select("image_id", "ox", "oy"), 0), text


def flatten(stack: list[dict], width: int, height: int, spark: SparkSession, image_id: int = 0) -> DataFrame:
    """Layers from the bottom up on a transparent canvas: dicts with pixels, mode, opacity, dx, dy, visible."""
    from ..sources.rasters import grid

    out = grid(spark, width, height, image_id).select(*KEY, *[F.lit(0).alias(c) for c in "rgba"])
    for layer in stack:
        if layer.get("visible", True):
            out = composite(out, layer["pixels"], layer.get("mode", "over"), layer.get("dx", 0), layer.get("dy", 0), by_image=False, opacity=layer.get("opacity", 1.0))
    return out


def coalesce_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Replay frames (seq_id, scene, page_x, page_y, dispose, y, x, r, g, b, a) into full canvases: seq_id, scene, y, x, r, g, b, a.

    The canvas is a state that each frame changes, so a sequence is one group, in order of scene.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((height, width, 4), np.int32)
        out = []
        ys, xs = np.mgrid[0:height, 0:width]
        for scene, f in pdf.groupby("scene", sort=True):
            saved = canvas.copy()
            y, x = (f.y + f.page_y).to_numpy(), (f.x + f.page_x).to_numpy()
            a = f.a.fillna(M).to_numpy()
            ok = (y >= 0) & (y < height) & (x >= 0) & (x < width) & (a > 0)
            canvas[y[ok], x[ok]] = np.stack([f.r, f.g, f.b, a], axis=1)[ok].astype(np.int32)
            out.append(pd.DataFrame({"seq_id": pdf.seq_id.iloc[0], "scene": scene, "y": ys.ravel(), "x": xs.ravel(), **{c: canvas[:, :, k].ravel() for k, c in enumerate("rgba")}}))
            dispose = f.dispose.iloc[0]
            if dispose == "background":
                canvas[y[ok], x[ok]] = 0
            elif dispose == "previous":
                canvas = saved
        return pd.concat(out) if out else pd.DataFrame(columns=["seq_id", "scene", "y", "x", *"rgba"])

    return frames.groupBy("seq_id").applyInPandas(run, "seq_id long, scene int, y int, x int, r int, g int, b int, a int")
