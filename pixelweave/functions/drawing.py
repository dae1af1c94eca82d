"""Vector shapes as tables of pixels: each gives image_id, y, x and coverage (0..1) inside a canvas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rasters import grid
from .quantum import M

KEY = ["image_id", "y", "x"]


def _shape(spark: SparkSession, width: int, height: int, coverage: Column) -> DataFrame:
    return grid(spark, width, height).select(*KEY, F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0)).alias("coverage")).where("coverage > 0")


def _x() -> Column:
    return F.col("x") + 0.5


def _y() -> Column:
    return F.col("y") + 0.5


def rectangle(spark: SparkSession, width: int, height: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Exact area of each pixel below the rectangle."""
    part = lambda c, a, b: F.greatest(F.lit(0.0), F.least(F.col(c) + 1.0, F.lit(float(b))) - F.greatest(F.col(c) + 0.0, F.lit(float(a))))
    return _shape(spark, width, height, part("x", x0, x1) * part("y", y0, y1))


def ellipse(spark: SparkSession, width: int, height: int, cx: float, cy: float, rx: float, ry: float) -> DataFrame:
    """Soft at the edge over one pixel."""
    d = F.sqrt((_x() - cx) * (_x() - cx) / (rx * rx) + (_y() - cy) * (_y() - cy) / (ry * ry))
    return _shape(spark, width, height, (1 - d) * min(rx, ry) + 0.5)


def line(spark: SparkSession, width: int, height: int, x0: float, y0: float, x1: float, y1: float, stroke: float = 1.0) -> DataFrame:
    """Distance to the segment, soft over one pixel, round ends."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.lit(0.0) if n == 0 else F.least(F.greatest(((_x() - x0) * dx + (_y() - y0) * dy) / n, F.lit(0.0)), F.lit(1.0))
    px, py = _x() - (t * dx + x0), _y() - (t * dy + y0)
    return _shape(spark, width, height, stroke / 2 + 0.5 - F.sqrt(px * px + py * py))


def polygon(spark: SparkSession, width: int, height: int, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Pixels whose centre lies inside, by the even-odd rule."""
    inside = F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]], strict=True):
        if ya == yb:
            continue
        low, high = min(ya, yb), max(ya, yb)
        crosses = (_y() >= low) & (_y() < high) & (_x() < (_y() - ya) * ((xb - xa) / (yb - ya)) + xa)
        inside = inside + crosses.cast("int")
    return _shape(spark, width, height, (inside % 2).cast("double"))


def bezier(p0, p1, p2, p3, steps: int = 16) -> list[tuple[float, float]]:
    """Points of a cubic curve, for lines and polygons."""
    out = []
    for k in range(steps + 1):
        t = k / steps
        w = ((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3)
        out.append((sum(a * p[0] for a, p in zip(w, (p0, p1, p2, p3), strict=True)), sum(a * p[1] for a, p in zip(w, (p0, p1, p2, p3), strict=True))))
    return out


def arc(cx: float, cy: float, rx: float, ry: float, start: float, stop: float, steps: int = 32) -> list[tuple[float, float]]:
    return [(cx + rx * math.cos(math.radians(start + (stop - start) * k / steps)), cy + ry * math.sin(math.radians(start + (stop - start) * k / steps))) for k in range(steps + 1)]


def paint(df: DataFrame, shape: DataFrame, color: Sequence[int], opacity: float = 1.0) -> DataFrame:
    """``df`` with a shape laid over every image."""
    rows = df.join(shape.select("y", "x", "coverage"), ["y", "x"], "left")
    t = F.coalesce("coverage", F.lit(0.0)) * opacity
    return rows.select(*KEY, *[F.floor(F.col(c) * (1 - t) + t * k + 0.5).cast("int").alias(c) for c, k in zip("rgb", color, strict=True)], F.when(F.col("a").isNotNull(), F.greatest(F.col("a"), F.floor(t * M + 0.5).cast("int"))).alias("a"))


def polyline(spark: SparkSession, width: int, height: int, points: Sequence[tuple[float, float]], stroke: float = 1.0, dashes: Sequence[float] = ()) -> DataFrame:
    """An open stroke: the distance to the nearest of its segments; ``dashes``: lengths drawn and left out in turn."""
    parts = dashed(points, dashes) if dashes else list(zip(points, points[1:], strict=False))
    near = F.lit(float("inf"))
    for (xa, ya), (xb, yb) in parts:
        dx, dy = xb - xa, yb - ya
        n = dx * dx + dy * dy
        t = F.lit(0.0) if n == 0 else F.least(F.greatest(((_x() - xa) * dx + (_y() - ya) * dy) / n, F.lit(0.0)), F.lit(1.0))
        px, py = _x() - (t * dx + xa), _y() - (t * dy + ya)
        near = F.least(near, px * px + py * py)
    return _shape(spark, width, height, stroke / 2 + 0.5 - F.sqrt(near))


def dashed(points: Sequence[tuple[float, float]], dashes: Sequence[float]) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """The drawn pieces of a line of points."""
    out, k, left = [], 0, dashes[0]
    for (xa, ya), (xb, yb) in zip(points, points[1:], strict=False):
        length, at = math.hypot(xb - xa, yb - ya), 0.0
        while length - at > 1e-9:
            step = min(left, length - at)
            if k % 2 == 0:
                out.append(tuple((xa + (xb - xa) * v / length, ya + (yb - ya) * v / length) for v in (at, at + step)))
            at, left = at + step, left - step
            if left <= 1e-9:
                k += 1
                left = dashes[k % len(dashes)]
    return out


def regular_polygon(cx: float, cy: float, radius: float, sides: int) -> list[tuple[float, float]]:
    """Corners from the top on."""
    return [(cx + radius * math.cos(2 * math.pi * k / sides - math.pi / 2), cy + radius * math.sin(2 * math.pi * k / sides - math.pi / 2)) for k in range(sides)]


def star(cx: float, cy: float, outer: float, inner: float, points: int) -> list[tuple[float, float]]:
    """Outer and inner corners in turn, from the top on."""
    return [(cx + r * math.cos(math.pi * k / points - math.pi / 2), cy + r * math.sin(math.pi * k / points - math.pi / 2)) for k in range(2 * points) for r in [inner if k % 2 else outer]]


def circle(cx: float, cy: float, radius: float, steps: int = 64) -> list[tuple[float, float]]:
    return [(cx + radius * math.cos(2 * math.pi * k / steps), cy + radius * math.sin(2 * math.pi * k / steps)) for k in range(steps)]


def rounded_rectangle(x: float, y: float, w: float, h: float, rx: float, ry: float, steps: int = 8) -> list[tuple[float, float]]:
    """Corners as quarter ellipses."""
    rx, ry = min(rx, w / 2), min(ry, h / 2)
    corners = [(x + w - rx, y + ry, -90), (x + w - rx, y + h - ry, 0), (x + rx, y + h - ry, 90), (x + rx, y + ry, 180)]
    return [(cx + rx * math.cos(math.radians(a + 90 * k / steps)), cy + ry * math.sin(math.radians(a + 90 * k / steps))) for cx, cy, a in corners for k in range(steps + 1)]


def parse_path(text: str) -> list[list[tuple[float, float]]]:
    """The lines of points of an SVG path: M, L, H, V, C, Q and Z, absolute and relative."""
    import re

    out: list[list[tuple[float, float]]] = []
    tokens = re.findall(r"[MLHVCQZmlhvcqz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)
    at, here, begin, command = 0, (0.0, 0.0), (0.0, 0.0), ""
    while at < len(tokens):
        if tokens[at].isalpha():
            command = tokens[at]
            at += 1
        elif command in ("", "Z", "z"):
            raise ValueError("a path begins with a command, as does what follows a closed line")
        if command in ("Z", "z"):
            if out:
                out[-1].append(begin)
            here = begin
            continue
        kind, rel = command.upper(), command.islower()
        n = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "Q": 4}[kind]
        values = [float(v) for v in tokens[at : at + n]]
        if len(values) < n:
            raise ValueError("a path command lacks numbers")
        at += n
        if kind == "H":
            points = [(values[0] + (here[0] if rel else 0), here[1])]
        elif kind == "V":
            points = [(here[0], values[0] + (here[1] if rel else 0))]
        else:
            points = [(values[k] + (here[0] if rel else 0), values[k + 1] + (here[1] if rel else 0)) for k in range(0, n, 2)]
        if kind == "M":
            out.append(list(points))
            begin, command = points[0], "l" if rel else "L"
        elif kind == "C":
            out[-1] += bezier(here, *points)[1:]
        elif kind == "Q":
            a, b = points
            out[-1] += bezier(here, *[tuple(p + (q - p) * 2 / 3 for p, q in zip(e, a, strict=True)) for e in (here, b)], b)[1:]
        else:
            out[-1] += points
        here = points[-1]
    return out


class Turtle:
    """A stack of transforms for points: translate, rotate, scale, push and pop."""

    def __init__(self):
        from .adjust import Affine

        self.kind, self.now, self.held = Affine, Affine(), []

    def push(self) -> None:
        self.held.append(self.now)

    def pop(self) -> None:
        self.now = self.held.pop()

    def reset(self) -> None:
        self.now = self.kind()

    def translate(self, x: float, y: float) -> None:
        self.now = self.kind.translation(x, y).then(self.now)

    def rotate(self, degrees: float) -> None:
        self.now = self.kind.rotation(degrees).then(self.now)

    def scale(self, x: float, y: float) -> None:
        self.now = self.kind.scale(x, y).then(self.now)

    def apply(self, points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
        a, b, c, d, tx, ty = self.now.m
        return [(x * a + y * c + tx, x * b + y * d + ty) for x, y in points]


def paint_linear(df: DataFrame, shape: DataFrame, x1: float, y1: float, x2: float, y2: float, start: Sequence[int], stop: Sequence[int]) -> DataFrame:
    """A shape filled with a gradient between two places."""
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
    t = (((_x() - x1) * (x2 - x1) + (_y() - y1) * (y2 - y1)) / n) if n else F.lit(0.0)
    return _painted(df, shape, t, start, stop)


def paint_radial(df: DataFrame, shape: DataFrame, cx: float, cy: float, radius: float, centre: Sequence[int], outer: Sequence[int]) -> DataFrame:
    """A shape filled outwards from a centre."""
    return _painted(df, shape, F.sqrt((_x() - cx) * (_x() - cx) + (_y() - cy) * (_y() - cy)) / max(radius, 1e-9), centre, outer)


def _painted(df: DataFrame, shape: DataFrame, t: Column, start: Sequence[int], stop: Sequence[int]) -> DataFrame:
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    joined = df.join(shape.select("y", "x", "coverage"), ["y", "x"], "left")
    k = F.coalesce("coverage", F.lit(0.0))
    value = lambda c, a, b: F.floor(F.round(F.col(c) * (1 - k) + (t * float(b - a) + float(a)) * k, 6) + 0.5).cast("int")
    return joined.select(*KEY, *[value(c, a, b).alias(c) for c, a, b in zip("rgb", start, stop, strict=True)], "a")
