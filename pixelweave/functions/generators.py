"""Table-valued sources: fills, gradients, patterns, noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rasters import grid
from .quantum import M

KEY = ["image_id", "y", "x"]


def _out(canvas: DataFrame, r: Column, g: Column | None = None, b: Column | None = None) -> DataFrame:
    return canvas.select(*KEY, r.cast("int").alias("r"), (r if g is None else g).cast("int").alias("g"), (r if b is None else b).cast("int").alias("b"), F.lit(None).cast("int").alias("a"))


def solid(spark: SparkSession, width: int, height: int, color: Sequence[int]) -> DataFrame:
    return _out(grid(spark, width, height), *[F.lit(c) for c in color])


def linear_gradient(spark: SparkSession, width: int, height: int, start: Sequence[int], stop: Sequence[int], degrees: float = 0.0) -> DataFrame:
    """Between two colours along a direction, from edge to edge."""
    dx, dy = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    reach = abs(dx) * (width - 1) + abs(dy) * (height - 1)
    t = ((F.col("x") - (width - 1) / 2.0) * dx + (F.col("y") - (height - 1) / 2.0) * dy) / (reach or 1.0) + 0.5
    return _out(grid(spark, width, height), *[F.floor(t * (q - p) + p + 0.5) for p, q in zip(start, stop, strict=True)])


def radial_gradient(spark: SparkSession, width: int, height: int, inner: Sequence[int], outer: Sequence[int]) -> DataFrame:
    cx, cy = (width - 1) / 2.0, (height - 1) / 2.0
    d = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)) / (math.hypot(cx, cy) or 1.0)
    t = F.least(d, F.lit(1.0))
    return _out(grid(spark, width, height), *[F.floor(t * (q - p) + p + 0.5) for p, q in zip(inner, outer, strict=True)])


def checkerboard(spark: SparkSession, width: int, height: int, size: int = 8, light: int = M, dark: int = 0) -> DataFrame:
    even = (F.floor(F.col("x") / size) + F.floor(F.col("y") / size)) % 2 == 0
    return _out(grid(spark, width, height), F.when(even, light).otherwise(dark))


def stripes(spark: SparkSession, width: int, height: int, period: int = 4, vertical: bool = False) -> DataFrame:
    return _out(grid(spark, width, height), F.when(F.col("x" if vertical else "y") % period < period // 2, M).otherwise(0))


def hashed(x: Column, y: Column, seed: int) -> Column:
    """A fixed pseudo-random value in 0..1 of a lattice place."""
    return F.pmod(F.xxhash64(x.cast("int"), y.cast("int"), F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)


def value_noise(spark: SparkSession, width: int, height: int, scale: float = 8.0, octaves: int = 3, seed: int = 0) -> DataFrame:
    """Smoothly blended lattice values, summed over octaves."""
    total, weight = None, 0.0
    for k in range(octaves):
        step = scale / 2**k
        px, py = F.col("x") / step, F.col("y") / step
        ix, iy = F.floor(px), F.floor(py)
        fx, fy = px - ix, py - iy
        sx, sy = fx * fx * (3 - fx * 2), fy * fy * (3 - fy * 2)
        corner = lambda a, b, ix=ix, iy=iy, k=k: hashed(ix + a, iy + b, seed + k)
        top = corner(0, 0) * (1 - sx) + corner(1, 0) * sx
        low = corner(0, 1) * (1 - sx) + corner(1, 1) * sx
        v = (top * (1 - sy) + low * sy) * 0.5**k
        total, weight = v if total is None else total + v, weight + 0.5**k
    return _out(grid(spark, width, height), F.floor(total / weight * M + 0.5))


def add_noise(df: DataFrame, kind: str = "uniform", attenuate: float = 1.0, seed: int = 0) -> DataFrame:
    """Seeded noise by place: uniform, gaussian, impulse, laplacian, multiplicative or poisson."""

    def noisy(c: str, k: int) -> Column:
        u = F.pmod(F.xxhash64(*KEY, F.lit(seed * 8 + k)), F.lit(1 << 24)) / float(1 << 24) + 1e-9
        w = F.pmod(F.xxhash64(*KEY, F.lit(seed * 8 + k + 4)), F.lit(1 << 24)) / float(1 << 24)
        normal = F.sqrt(F.log(u) * -2) * F.cos(w * (2 * math.pi))
        v = F.col(c).cast("double")
        out = {
            "uniform": v + (u - 0.5) * (attenuate * M * 0.2),
            "gaussian": v + normal * (attenuate * M * 0.05),
            "impulse": F.when(u < 0.05 * attenuate, 0.0).when(u > 1 - 0.05 * attenuate, float(M)).otherwise(v),
            "laplacian": v + F.signum(u - 0.5) * F.log(F.greatest(1 - F.abs(u - 0.5) * 2, F.lit(1e-9))) * (-attenuate * M * 0.03),
            "multiplicative": v + v * normal * (attenuate * 0.2),
            "poisson": v + F.sqrt(F.greatest(v, F.lit(0.0)) / M) * normal * (attenuate * M * 0.05),
        }[kind]
        return F.floor(F.least(F.greatest(out, F.lit(0.0)), F.lit(float(M))) + 0.5).cast("int")

    return df.withColumns({c: noisy(c, k) for k, c in enumerate("rgb")})


def identity_hald(spark: SparkSession, level: int) -> DataFrame:
    """The identity Hald image of level n: n**3 square, the red digit running fastest."""
    n, side = level * level, level**3
    i = F.col("y") * side + F.col("x")
    digit = lambda k: F.floor(F.floor(i / n**k) % n * M / max(n - 1, 1))
    return _out(grid(spark, side, side), digit(0), digit(1), digit(2))


def apply_hald(df: DataFrame, hald: DataFrame, level: int) -> DataFrame:
    """Colours through a 3-D table, trilinear: eight equi-joins' worth of taps in one exploded lookup.

    ``hald`` is one image of level**6 rows, a bound fixed by the level, so it is broadcast up to level 8.
    """
    n, side = level * level, level**3
    table = hald.select((F.col("y") * side + F.col("x")).cast("int").alias("i"), F.col("r").alias("hr"), F.col("g").alias("hg"), F.col("b").alias("hb"))
    at = [F.col(c) / float(M) * (n - 1) for c in "rgb"]
    low = [F.least(F.floor(p), F.lit(max(n - 2, 0))) for p in at]
    taps = []
    for m in range(8):
        index, weight = None, None
        for k in range(3):
            up = m >> k & 1
            part = (low[k] + up) * n**k
            w = (at[k] - low[k]) if up else 1 - (at[k] - low[k])
            index, weight = part if index is None else index + part, w if weight is None else weight * w
        taps.append(F.struct(F.least(index, F.lit(n**3 - 1)).cast("int").alias("i"), weight.alias("w")))
    rows = df.select(*KEY, "a", F.explode(F.array(*taps)).alias("t")).select(*KEY, "a", F.col("t.i").alias("i"), F.col("t.w").alias("w"))
    out = rows.join(F.broadcast(table) if level <= 8 else table, "i")
    return out.groupBy(*KEY).agg(*[F.floor(F.round(F.sum(F.col(f"h{c}") * F.col("w")), 6) + 0.5).cast("int").alias(c) for c in "rgb"], F.max("a").alias("a"))
