"""Procedural textures: gradient, simplex and cell noise, sums of octaves, marble and wood, as expressions of a pixel's place.

The lattice is drawn from a hash of its coordinates and the seed, so any tile of a texture is made alone, anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rasters import grid
from .generators import _out
from .quantum import M, q16

Noise = Callable[[Column, Column], Column]


def lattice(x: Column, y: Column, seed: int) -> Column:
    """0..1 of a lattice place: six hexadecimal digits of the md5 of "x,y,seed"."""
    text = F.concat_ws(",", x.cast("long").cast("string"), y.cast("long").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") / 16777216.0


def _slope(x: Column, y: Column, dx: Column, dy: Column, seed: int) -> Column:
    turn = lattice(x, y, seed) * (2 * math.pi)
    return F.cos(turn) * dx + F.sin(turn) * dy


def perlin(x: Column, y: Column, seed: int = 0) -> Column:
    """Gradient noise, about -1..1."""
    ix, iy = F.floor(x), F.floor(y)
    fx, fy = x - ix, y - iy
    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    u, v = fade(fx), fade(fy)
    at = lambda a, b: _slope(ix + a, iy + b, fx - a, fy - b, seed)
    top, low = at(0, 0) + (at(1, 0) - at(0, 0)) * u, at(0, 1) + (at(1, 1) - at(0, 1)) * u
    return (top + (low - top) * v) * math.sqrt(2)


def simplex(x: Column, y: Column, seed: int = 0) -> Column:
    """Noise on a lattice of triangles, about -1..1."""
    skew, back = (math.sqrt(3) - 1) / 2, (3 - math.sqrt(3)) / 6
    s = (x + y) * skew
    ix, iy = F.floor(x + s), F.floor(y + s)
    x0, y0 = x - ix + (ix + iy) * back, y - iy + (ix + iy) * back
    right = (x0 > y0).cast("int")
    total = F.lit(0.0)
    for a, b, k in ((F.lit(0), F.lit(0), 0), (right, 1 - right, 1), (F.lit(1), F.lit(1), 2)):
        dx, dy = x0 - a + k * back, y0 - b + k * back
        t = F.greatest(0.5 - dx * dx - dy * dy, F.lit(0.0))
        total = total + t * t * t * t * _slope(ix + a, iy + b, dx, dy, seed)
    return total * 99.2


def worley(x: Column, y: Column, seed: int = 0, metric: str = "euclidean", between: bool = False) -> Column:
    """Distance to the nearest of one point in each cell, or how much farther the second one is (``between``)."""
    ix, iy = F.floor(x), F.floor(y)
    far = []
    for b in (-1, 0, 1):
        for a in (-1, 0, 1):
            dx, dy = ix + a + lattice(ix + a, iy + b, seed) - x, iy + b + lattice(ix + a, iy + b, seed + 1) - y
            far.append({"euclidean": F.sqrt(dx * dx + dy * dy), "manhattan": F.abs(dx) + F.abs(dy), "chebyshev": F.greatest(F.abs(dx), F.abs(dy))}[metric])
    ordered = F.array_sort(F.array(*far))
    return F.element_at(ordered, 2) - F.element_at(ordered, 1) if between else F.element_at(ordered, 1)


def fbm(x: Column, y: Column, octaves: int = 6, persistence: float = 0.5, lacunarity: float = 2.0, seed: int = 0, noise: Callable = perlin, folded: bool = False) -> Column:
    """Octaves of ever finer and weaker noise, over their weights; ``folded`` (turbulence) takes absolute values."""
    total = sum((F.abs(n) if folded else n) * persistence**k for k in range(octaves) for n in [noise(x * lacunarity**k, y * lacunarity**k, seed + k)])
    return total / sum(persistence**k for k in range(octaves))


def texture(spark: SparkSession, width: int, height: int, noise: Noise, frequency: float = 4.0, signed: bool = True) -> DataFrame:
    """A gray image of a noise; signed ones are moved from -1..1 to 0..1."""
    v = noise(F.col("x") / float(width) * frequency, F.col("y") / float(height) * frequency)
    return _out(grid(spark, width, height), q16(F.round((v * 0.5 + 0.5 if signed else v) * float(M), 6)))


def marble(spark: SparkSession, width: int, height: int, frequency: float = 5.0, power: float = 5.0, octaves: int = 6, seed: int = 0) -> DataFrame:
    """Sine veins that turbulence shifts."""
    return texture(spark, width, height, lambda x, y: F.sin(x + fbm(x, y, octaves, seed=seed, folded=True) * power), frequency)


def wood(spark: SparkSession, width: int, height: int, rings: float = 12.0, power: float = 0.1, frequency: float = 4.0, seed: int = 0) -> DataFrame:
    """Rings about the centre between two browns, shifted by noise."""
    x, y = (F.col("x") / float(width) - 0.5) * frequency, (F.col("y") / float(height) - 0.5) * frequency
    far = F.sqrt(x * x + y * y) + perlin(x * 2, y * 2, seed) * power
    ring = (F.sin(far * rings * math.pi) + 1) * 0.5
    mix = lambda dark, light: (F.floor(F.round(ring * ((light - dark) * 257.0), 6)) + dark * 257).cast("int")
    return _out(grid(spark, width, height), mix(100, 200), mix(60, 150), mix(20, 80))


def plasma(spark: SparkSession, width: int, height: int, seed: int = 0) -> DataFrame:
    """Three independent clouds, one a channel."""
    clouds = [fbm(F.col("x") / float(width) * 2, F.col("y") / float(height) * 2, 7, 0.6, seed=seed + 100 * k) for k in range(3)]
    return _out(grid(spark, width, height), *[q16(F.round((v * 0.5 + 0.5) * float(M), 6)) for v in clouds])


def _stops(t: Column, stops: list[tuple[float, int, int, int]]) -> list[Column]:
    """Colours (16 bits) at a place 0..1 between stops (place, r, g, b)."""
    stops = sorted(stops)
    out = []
    for c in (1, 2, 3):
        v = F.when(t <= stops[0][0], float(stops[0][c]))
        for one, two in zip(stops, stops[1:], strict=False):
            v = v.when(t <= two[0], (t - one[0]) / max(two[0] - one[0], 1e-12) * float(two[c] - one[c]) + one[c])
        out.append(q16(F.round(v.otherwise(float(stops[-1][c])), 6)))
    return out


def linear_stops(spark: SparkSession, width: int, height: int, stops: list[tuple[float, int, int, int]], degrees: float = 0.0) -> DataFrame:
    """Any number of colours along a direction, from corner to corner."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    cx, cy = (width - 1) * 0.5, (height - 1) * 0.5
    reach = abs(cx * c) + abs(cy * s)
    t = ((F.col("x") - cx) * c + (F.col("y") - cy) * s) * (0.5 / reach if reach > 0 else 0.0) + 0.5
    return _out(grid(spark, width, height), *_stops(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), stops))


def radial_stops(spark: SparkSession, width: int, height: int, stops: list[tuple[float, int, int, int]], cx: float = 0.5, cy: float = 0.5) -> DataFrame:
    """Any number of colours outwards to the farthest corner."""
    x, y = cx * (width - 1), cy * (height - 1)
    reach = max(math.hypot(x - a, y - b) for a in (0, width - 1) for b in (0, height - 1))
    t = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)) / (reach or 1.0)
    return _out(grid(spark, width, height), *_stops(F.least(t, F.lit(1.0)), stops))


#: Small bitmaps, a row of bits each, highest bit first, with their width.
PATTERNS = {
    "checkerboard": (2, [0b10, 0b01]), "horizontal": (1, [1, 0]), "vertical": (2, [0b10]), "leftdiagonal": (4, [0b1000, 0b0100, 0b0010, 0b0001]), "rightdiagonal": (4, [0b0001, 0b0010, 0b0100, 0b1000]),
    "cross": (4, [0b1111, 0b1000, 0b1000, 0b1000]), "dots": (4, [0b1000, 0, 0b0010, 0]), "bricks": (8, [0b11111111, 0b10000000, 0b10000000, 0b10000000, 0b11111111, 0b00001000, 0b00001000, 0b00001000]),
    "crosshatch": (4, [0b1001, 0b0110, 0b0110, 0b1001]), "gray25": (4, [0b1000, 0b0010]), "gray50": (2, [0b10, 0b01]), "gray75": (4, [0b0111, 0b1101]),
}


def pattern(spark: SparkSession, width: int, height: int, name: str, front: tuple[int, int, int] = (0, 0, 0), back: tuple[int, int, int] = (M, M, M)) -> DataFrame:
    """A bitmap of PATTERNS repeated over the canvas in two colours."""
    n, rows = PATTERNS[name]
    bits = F.array(*[F.lit(r) for r in rows])
    on = F.call_function("shiftright", F.element_at(bits, (F.col("y") % len(rows)).cast("int") + 1), (n - 1 - F.col("x") % n).cast("int")).bitwiseAND(1) == 1
    return _out(grid(spark, width, height), *[F.when(on, a).otherwise(b) for a, b in zip(front, back, strict=True)])
