"""Further point operators: colour vision, dodging, lookup images, hidden marks, coordinates, rectangles and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .colorspaces import decode, encode, times
from .point import put
from .quantum import M, clamp, from_unit, luma, q16, t16, unit

RGB = ("r", "g", "b")

#: Linear RGB as seen with each colour vision deficiency, and where daltonizing moves the error.
VISION = {
    "protanopia": ([[0.152286, 1.052583, -0.204868], [0.114503, 0.786281, 0.099216], [-0.003882, -0.048116, 1.051998]], [[0, 0, 0], [0.7, 1, 0], [0.7, 0, 1]]),
    "deuteranopia": ([[0.367322, 0.860646, -0.227968], [0.280085, 0.672501, 0.047413], [-0.011820, 0.042940, 0.968881]], [[1, 0.7, 0], [0, 0, 0], [0, 0.7, 1]]),
    "tritanopia": ([[1.255528, -0.076749, -0.178779], [-0.078411, 0.930809, 0.147602], [0.004733, 0.691367, 0.303900]], [[1, 0, 0.7], [0, 1, 0.7], [0, 0, 0]]),
}


def _seen(kind: str) -> list[Column]:
    return [from_unit(encode(clamp(v, 0, 1))) for v in times(VISION[kind][0], [decode(unit(c)) for c in RGB])]


def color_blindness(df: DataFrame, kind: str) -> DataFrame:
    """The image as it is seen with a deficiency: a matrix on linear values."""
    return put(df, *_seen(kind))


def daltonize(df: DataFrame, kind: str, strength: float = 1.0) -> DataFrame:
    """What the deficiency loses is moved to the channels that it leaves."""
    lost = [(F.col(c) - v) / float(M) for c, v in zip(RGB, _seen(kind), strict=True)]
    return put(df, *[from_unit(clamp(unit(c) + v * strength, 0, 1)) for c, v in zip(RGB, times(VISION[kind][1], lost), strict=True)])


def _tone(exposure: float, tone: float) -> Column:
    d = luma() / float(M) - tone
    return F.exp(-(d * d) / (2 * 0.15 * 0.15)) * exposure


def dodge(df: DataFrame, exposure: float = 0.5, tone: float = 0.5) -> DataFrame:
    """Lighter near a tone, with a Gaussian of deviation 0.15 on luma."""
    e = _tone(exposure, tone)
    return put(df, *[F.when(e < 1, t16(unit(c) / (1 - e * 0.5) * float(M))).otherwise(M) for c in RGB])


def burn(df: DataFrame, exposure: float = 0.5, tone: float = 0.5) -> DataFrame:
    """Darker near a tone."""
    left = 1 - _tone(exposure, tone) * 0.5
    return put(df, *[F.when(left > 0, t16((1 - (1 - unit(c)) / left) * float(M))).otherwise(0) for c in RGB])


def apply_clut(df: DataFrame, clut: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Each channel's value looked up on the diagonal of a colour table image of a size (w, h); one row of at most w + h entries is broadcast."""
    w, h = size
    at = lambda v: F.struct(F.floor(v / float(M) * (w - 1)).cast("int").alias("x"), F.floor(v / float(M) * (h - 1)).cast("int").alias("y"))
    # the places that a value can ask for: a staircase along the diagonal
    steps = clut.where((F.abs(F.col("x") * max(h - 1, 1) - F.col("y") * max(w - 1, 1)) <= max(w, h)))
    table = steps.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct("x", "y"), F.struct(*RGB)))).alias("clut"))
    rows = df.join(F.broadcast(table))
    return rows.withColumns({c: F.element_at("clut", at(F.col(c)))[c] for c in RGB}).drop("clut")


def polynomial_of_images(stack: DataFrame, terms: Sequence[tuple[float, float]], of: str = "layer") -> DataFrame:
    """Sum of weight * value ^ exponent over the images of a stack (``of``: their number from 0); one aggregate by pixel, truncated."""
    term = lambda k: F.element_at(F.array(*[F.lit(float(t[k])) for t in terms]), F.col(of) + 1)
    known = stack.where(F.col(of) < len(terms))
    return known.groupBy("image_id", "y", "x").agg(*[t16(F.round(F.sum(F.pow(unit(c), term(1)) * term(0)) * float(M), 6)).alias(c) for c in RGB])


def fuzzy_equal(one: Sequence[Column], two: Sequence[Column], fuzz: float, alpha: tuple[Column, Column] | None = None) -> Column:
    """Whether the squared distance is within fuzz squared; with alphas these count whole, colours by the larger one's share."""
    distance, scale = F.lit(0.0), F.lit(1.0)
    if alpha:
        a, b = alpha
        distance, scale = (a - b) * (a - b), F.greatest(a / float(M) / float(M), b / float(M))
    for x, y in zip(one, two, strict=True):
        distance = distance + scale * (x - y) * (x - y)
    return distance <= fuzz * fuzz


def map_coordinate(x: Column, y: Column, w: int, h: int, method: str) -> Column:
    """struct(x, y) of the pixel that stands for a place outside the image, or null where a constant colour does."""
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    edge = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    tile = lambda v, n: F.pmod(v, F.lit(n))

    def mirror(v: Column, n: int) -> Column:
        if n <= 1:
            return F.lit(0)
        k = F.pmod(v, F.lit(2 * (n - 1)))
        return F.when(k < n, k).otherwise(2 * (n - 1) - k)

    at = lambda a, b: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"))
    places = {
        "edge": at(edge(x, w), edge(y, h)),
        "mirror": at(mirror(x, w), mirror(y, h)),
        "tile": at(tile(x, w), tile(y, h)),
        "horizontaltile": F.when((y >= 0) & (y < h), at(tile(x, w), y)),
        "verticaltile": F.when((x >= 0) & (x < w), at(x, tile(y, h))),
        "checkertile": F.when((F.floor(x / w) + F.floor(y / h)) % 2 == 0, at(tile(x, w), tile(y, h))),
    }
    return F.when(inside, at(x, y)).otherwise(places[method]) if method in places else F.when(inside, at(x, y))


def _bits(pixels: Column, n: int, depth: int) -> Column:
    """For a pixel's running number in a mark of ``n`` pixels: (bit, running number) of each of its bits, highest first."""
    return F.array(*[F.struct(F.lit(b).alias("bit"), (pixels + (depth - 1 - b) * n).alias("step")) for b in range(depth - 1, -1, -1)])


def hide_mark(cover: DataFrame, mark: DataFrame, cover_size: tuple[int, int], mark_size: tuple[int, int], depth: int = 1) -> DataFrame:
    """The 8-bit luma of a mark, bit plane by bit plane, in the lowest bits of successive pixels and channels; the last write counts."""
    (w, h), (mw, mh) = cover_size, mark_size
    level = F.floor(F.floor(luma("601")) * 255.0 / M + 0.5).cast("int")
    rows = mark.select("image_id", level.alias("level"), F.explode(_bits(F.col("y") * mw + F.col("x"), mw * mh, depth)).alias("b"))
    rows = rows.select("image_id", F.call_function("shiftright", F.col("level"), F.col("b.bit")).bitwiseAND(1).alias("bit"), F.col("b.step").alias("step"))
    placed = rows.groupBy("image_id", (F.col("step") % (w * h)).cast("int").alias("place"), (F.col("step") % 3).cast("int").alias("c")).agg(F.max(F.struct("step", "bit")).alias("last"))
    wide = placed.groupBy("image_id", "place").agg(*[F.max(F.when(F.col("c") == k, F.col("last.bit"))).alias(f"bit{k}") for k in range(3)])
    out = cover.withColumn("place", (F.col("y") * w + F.col("x")).cast("int")).join(wide, ["image_id", "place"], "left")
    return out.withColumns({c: F.when(F.col(f"bit{k}").isNull(), F.col(c)).otherwise(F.col(c).bitwiseAND(~1).bitwiseOR(F.col(f"bit{k}"))) for k, c in enumerate(RGB)}).drop("place", "bit0", "bit1", "bit2")


def find_mark(df: DataFrame, size: tuple[int, int], mark_size: tuple[int, int], depth: int = 1) -> DataFrame:
    """The gray mark that ``hide_mark`` left."""
    (w, h), (mw, mh) = size, mark_size
    steps = df.select("image_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(mw * mh - 1)))).select("image_id", "i", F.explode(_bits(F.col("i"), mw * mh, depth)).alias("b"))
    steps = steps.select("image_id", "i", "b.bit", (F.col("b.step") % 3).cast("int").alias("c"), (F.col("b.step") % (w * h)).cast("int").alias("place"))
    value = F.element_at(F.array(*RGB), F.col("c") + 1).bitwiseAND(1)
    rows = steps.join(df.select("image_id", (F.col("y") * w + F.col("x")).cast("int").alias("place"), *RGB), ["image_id", "place"])
    level = rows.groupBy("image_id", "i").agg(F.sum(F.call_function("shiftleft", value, F.col("bit"))).alias("level"))
    gray = q16(F.col("level") * float(M) / 255.0)
    return level.select("image_id", F.floor(F.col("i") / mw).cast("int").alias("y"), (F.col("i") % mw).cast("int").alias("x"), *[gray.alias(c) for c in RGB])


def intersect(one: Sequence[Column], two: Sequence[Column]) -> Column:
    """The overlap of two rectangles (x, y, width, height) as a struct; all zero where there is none."""
    left, top = F.greatest(one[0], two[0]), F.greatest(one[1], two[1])
    right, low = F.least(one[0] + one[2], two[0] + two[2]), F.least(one[1] + one[3], two[1] + two[3])
    some = (right > left) & (low > top)
    part = lambda v, n: F.when(some, v).otherwise(0).alias(n)
    return F.struct(part(left, "x"), part(top, "y"), part(right - left, "width"), part(low - top, "height"))


class Affine:
    """A matrix (a, b, c, d, tx, ty): x' = a x + c y + tx, y' = b x + d y + ty."""

    def __init__(self, a: float = 1, b: float = 0, c: float = 0, d: float = 1, tx: float = 0, ty: float = 0):
        self.m = (a, b, c, d, tx, ty)

    @classmethod
    def translation(cls, x: float, y: float) -> Affine:
        return cls(tx=x, ty=y)

    @classmethod
    def scale(cls, x: float, y: float) -> Affine:
        return cls(a=x, d=y)

    @classmethod
    def rotation(cls, degrees: float) -> Affine:
        import math

        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return cls(c, s, -s, c)

    def then(self, other: Affine) -> Affine:
        """This matrix first, the other after it."""
        a, b, c, d, x, y = self.m
        e, f, g, h, u, v = other.m
        return Affine(e * a + g * b, f * a + h * b, e * c + g * d, f * c + h * d, e * x + g * y + u, f * x + h * y + v)

    def inverse(self) -> Affine:
        a, b, c, d, x, y = self.m
        det = a * d - b * c
        if abs(det) < 1e-12:
            raise ValueError("the matrix can't be inverted")
        return Affine(d / det, -b / det, -c / det, a / det, (c * y - d * x) / det, (b * x - a * y) / det)

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        a, b, c, d, tx, ty = (float(v) for v in self.m)
        return x * a + y * c + tx, x * b + y * d + ty


def vignette_correction(df: DataFrame, size: tuple[int, int], strength: float = 1.0, midpoint: float = 0.5) -> DataFrame:
    """Gain 1 / max(1 - strength * max(0, r - midpoint)^2, 0.1) by the distance r from the centre, 1 in the corners."""
    w, h = size
    dx, dy = F.col("x") - w / 2.0, F.col("y") - h / 2.0
    off = F.greatest(F.lit(0.0), F.sqrt(dx * dx + dy * dy) / ((w / 2.0) ** 2 + (h / 2.0) ** 2) ** 0.5 - midpoint)
    gain = 1 / F.greatest(1 - off * off * strength, F.lit(0.1))
    return put(df, *[t16(F.col(c) * gain) for c in RGB])


def recombine(low: DataFrame, high: DataFrame) -> DataFrame:
    """The image of its low and high frequencies: low + high - 32767, clamped."""
    right = high.select("image_id", "y", "x", *[F.col(c).alias(f"h{c}") for c in RGB])
    return low.join(right, ["image_id", "y", "x"]).select("image_id", "y", "x", *[F.least(F.greatest(F.col(c) + F.col(f"h{c}") - 32767, F.lit(0)), F.lit(M)).cast("int").alias(c) for c in RGB])


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of 16-bit values."""
    part = lambda v: F.lpad(F.hex(F.floor(v / 257.0 + 0.5).cast("int")), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))
