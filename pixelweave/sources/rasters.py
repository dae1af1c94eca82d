"""Rasters as tables of pixels, from the driver's tables and from formulas.

``pixels_wide``: image_id long, y int, x int, r, g, b int (0..65535), a int or null. ``pixels_long``: one row a channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantum import M

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(e: Column) -> Column:
    return F.floor(F.least(F.greatest((e.cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * M + 0.5).cast("int")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v: each embedding as an 8 x 8 image; no shuffle."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return rows.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), _level(F.col("e")).alias("v"))


def rgb(spark: SparkSession, sf_dir: str, alpha: bool = False) -> DataFrame:
    """pixels_wide of three embeddings each; with ``alpha`` four. Whole vectors are grouped, then exploded.

    Where the last image has too few embeddings its other channels are of the middle level.
    """
    n = 4 if alpha else 3
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / n).alias("image_id"), (F.col("vec_id") % n).alias("c"), "embedding")
    planes = rows.groupBy("image_id").agg(*[F.coalesce(F.max(F.when(F.col("c") == k, F.col("embedding"))), F.array_repeat(F.lit(0.0).cast("float"), SIDE * SIDE)).alias(f"e{k}") for k in range(n)])
    names = ["r", "g", "b", "a"][:n]
    flat = planes.select("image_id", F.posexplode(F.arrays_zip(*[F.col(f"e{k}") for k in range(n)])).alias("i", "p"))
    out = flat.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), *[_level(F.col(f"p.e{k}")).alias(c) for k, c in enumerate(names)])
    return out if alpha else out.withColumn("a", F.lit(None).cast("int"))


def mosaic(spark: SparkSession, sf_dir: str, columns: int = 20) -> DataFrame:
    """One gray image of all embeddings, as pixels_wide."""
    p = gray(spark, sf_dir)
    return p.select(F.lit(0).cast("long").alias("image_id"), (F.floor(F.col("image_id") / columns) * SIDE + F.col("y")).cast("int").alias("y"), ((F.col("image_id") % columns) * SIDE + F.col("x")).cast("int").alias("x"), F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"), F.lit(None).cast("int").alias("a"))


def text_pages(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """One gray pixel a character: v = least(code point, 255) * 257."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "")).alias("i", "ch")).where(F.col("ch") != "")
    return rows.select("image_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), (F.least(F.ascii("ch"), F.lit(255)) * 257).cast("int").alias("v"))


def event_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sparse image: user (y) by hour of day (x), n events."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("y"), F.hour("ts").alias("x")).agg(F.count("*").alias("n"))


def grid(spark: SparkSession, width: int, height: int, image_id: int = 0) -> DataFrame:
    """An empty canvas: image_id, y, x. The two ranges are the axes of one image, so every pair is a pixel."""
    xs = F.sequence(F.lit(0), F.lit(width - 1))
    return spark.range(height).select(F.lit(image_id).cast("long").alias("image_id"), F.col("id").cast("int").alias("y"), F.explode(xs).alias("x"))


def gradient(spark: SparkSession, width: int, height: int) -> DataFrame:
    """r runs with x, g with y, b with both, by integer division."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    part = lambda n, d: F.floor(n * M / max(d, 1)).cast("int")
    return grid(spark, width, height).select("image_id", "y", "x", part(x, width - 1).alias("r"), part(y, height - 1).alias("g"), part(x + y, width + height - 2).alias("b"), F.lit(None).cast("int").alias("a"))


def to_long(wide: DataFrame) -> DataFrame:
    """pixels_wide → pixels_long (image_id, y, x, c, v); no row for a null channel."""
    return wide.select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b", "a")).alias("c", "v")).where(F.col("v").isNotNull())


def to_wide(long: DataFrame) -> DataFrame:
    return long.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgba")])
