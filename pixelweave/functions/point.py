"""Point operators: each takes a pixels_wide table and gives one, by a single projection.

Unless said otherwise they work on r, g, b and copy alpha. Bracketed: the rounding rule, [q] half up, [t] truncated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantum import M, clamp, from_unit, luma, q16, t16, to_byte, unit

RGB = ("r", "g", "b")


def each(df: DataFrame, f: Callable[[Column], Column], alpha: bool = False) -> DataFrame:
    """Apply ``f`` to every colour channel (and alpha, where present)."""
    names = (*RGB, "a") if alpha else RGB
    return df.withColumns({c: F.when(F.col(c).isNotNull(), f(F.col(c))) if c == "a" else f(F.col(c)) for c in names})


def put(df: DataFrame, r: Column, g: Column, b: Column) -> DataFrame:
    return df.withColumns({"r": r, "g": g, "b": b})


def all_of(df: DataFrame, v: Column) -> DataFrame:
    return put(df, v, v, v)


# --- arithmetic with a constant -------------------------------------------------------------------------------------------------

EVALUATE: dict[str, Callable[[Column, float], Column]] = {
    "add": lambda p, k: p + k,
    "subtract": lambda p, k: p - k,
    "multiply": lambda p, k: p * k,
    "divide": lambda p, k: p / k if k else p,
    "abs": lambda p, k: F.abs(p - k),
    "min": lambda p, k: F.least(p.cast("double"), F.lit(float(k))),
    "max": lambda p, k: F.greatest(p.cast("double"), F.lit(float(k))),
    "set": lambda p, k: F.lit(float(k)),
    "and": lambda p, k: p.bitwiseAND(int(k)),
    "or": lambda p, k: p.bitwiseOR(int(k)),
    "xor": lambda p, k: p.bitwiseXOR(int(k)),
    "leftshift": lambda p, k: F.shiftleft(p, int(k)).bitwiseAND(M),
    "rightshift": lambda p, k: F.shiftright(p, int(k)),
    "log": lambda p, k: F.log(p + 1.0) / math.log(k) * M / math.log(M + 1) if k > 0 and k != 1 else F.lit(0.0),
    "pow": lambda p, k: F.pow(p / float(M), F.lit(float(k))) * M,
    "cosine": lambda p, k: (F.cos(p / float(M) * (2 * math.pi * k)) + 1) * M / 2,
    "sine": lambda p, k: (F.sin(p / float(M) * (2 * math.pi * k)) + 1) * M / 2,
    "exponential": lambda p, k: F.pow(F.lit(float(k)), p / float(M)) * M,
    "inverselog": lambda p, k: (F.pow(F.lit(float(k)), p / float(M)) - 1) / (k - 1) * M if k > 1 else p,
    "thresholdblack": lambda p, k: F.when(p < k, 0).otherwise(p),
    "thresholdwhite": lambda p, k: F.when(p > k, M).otherwise(p),
    "threshold": lambda p, k: F.when(p > k, M).otherwise(0),
    "addmodulus": lambda p, k: (p + float(k)) % float(M + 1),
    "mean": lambda p, k: p,
}


def evaluate(df: DataFrame, op: str, k: float) -> DataFrame:
    """[t] One of 24 operators with a constant, on every channel and alpha."""
    return each(df, lambda p: t16(EVALUATE[op.lower()](p, k).cast("double")), alpha=True)


def apply_function(df: DataFrame, function: str, parameters: Sequence[float]) -> DataFrame:
    """[t] polynomial, sinusoid, arcsin or arctan on 0..1 values of every channel and alpha."""
    p = list(parameters)

    def f(v: Column) -> Column:
        u = v / float(M)
        if function == "polynomial":
            out = F.lit(0.0)
            for k in p:
                out = out * u + k
            return out
        if function == "sinusoid":
            freq, phase, amp, bias = (p + [1.0, 0.0, 0.5, 0.5][len(p) :])[:4]
            return F.sin((u * freq + phase / 360.0) * (2 * math.pi)) * amp + bias
        width, center, span, bias = (p + [1.0, 0.5, 1.0, 0.5][len(p) :])[:4]
        if function == "arcsin":
            return F.asin(clamp((u - center) * (2 / width), -1, 1)) * (span / math.pi) + bias
        if function == "arctan":
            return F.atan((u - center) * (math.pi * width)) * (span / math.pi) + bias
        raise ValueError(f"unknown function {function}")

    return each(df, lambda v: t16(f(v) * float(M)), alpha=True)


# --- tone ---------------------------------------------------------------------------------------------------------------------------


def brightness(df: DataFrame, factor: float) -> DataFrame:
    return each(df, lambda v: q16(v / float(M) * factor * M))


def contrast(df: DataFrame, factor: float) -> DataFrame:
    return each(df, lambda v: from_unit((v / float(M) - 0.5) * factor + 0.5))


def gamma(df: DataFrame, value: float) -> DataFrame:
    if value <= 0:
        raise ValueError("gamma must be positive")
    return each(df, lambda v: from_unit(F.pow(v / float(M), F.lit(1 / value))))


def grayscale(df: DataFrame) -> DataFrame:
    return all_of(df, q16(luma()))


def invert(df: DataFrame) -> DataFrame:
    return each(df, lambda v: M - v)


def mean_threshold(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """White where the integer mean of the channels reaches the threshold."""
    mean = F.floor((F.col("r") + F.col("g") + F.col("b")) / 3)
    return all_of(df, F.when(mean >= math.floor(threshold * M), M).otherwise(0))


def levels(df: DataFrame, in_black=0.0, in_white=1.0, out_black=0.0, out_white=1.0, mid_gamma=1.0) -> DataFrame:
    span = in_white - in_black if in_white > in_black else 1.0
    return each(df, lambda v: from_unit(F.pow(clamp((v / float(M) - in_black) / span, 0, 1), F.lit(1 / mid_gamma)) * (out_white - out_black) + out_black))


def posterize(df: DataFrame, n: int = 4) -> DataFrame:
    step = 1.0 / (max(n, 2) - 1)
    return each(df, lambda v: from_unit(F.bround(v / float(M) / step) * step))


def saturate(df: DataFrame, factor: float) -> DataFrame:
    lum = luma() / float(M)
    return each(df, lambda v: from_unit(lum + (v / float(M) - lum) * factor))


def color_matrix(df: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """3 x 3, or 3 x 4 with a constant in the last column, on 0..1 values."""
    u = [unit(c) for c in RGB]
    rows = [sum((u[k] * float(row[k]) for k in range(1, 3)), u[0] * float(row[0])) + (float(row[3]) if len(row) > 3 else 0.0) for row in matrix]
    return put(df, *[from_unit(x) for x in rows])


def exposure(df: DataFrame, stops: float) -> DataFrame:
    return each(df, lambda v: from_unit(v / float(M) * 2.0**stops))


def vibrance(df: DataFrame, amount: float) -> DataFrame:
    """[t] Saturation gain that falls with the pixel's own HSV saturation."""
    high, low = F.greatest(*RGB), F.least(*RGB)
    sat = F.when(high > 0, (high - low) / high).otherwise(0.0)
    lum, gain = luma(), (1 - sat) * amount + 1
    return put(df, *[t16(lum + (F.col(c) - lum) * gain) for c in RGB])


def curves(df: DataFrame, points: Sequence[tuple[float, float]]) -> DataFrame:
    """Monotone cubic (Fritsch-Carlson) through control points in 0..1, as one piecewise expression."""
    pts = sorted(points)
    n = len(pts)
    if n < 2:
        raise ValueError("curves need two points")
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    d = [(ys[i + 1] - ys[i]) / max(xs[i + 1] - xs[i], 1e-12) for i in range(n - 1)]
    m = [d[0], *[(d[i - 1] + d[i]) / 2 if d[i - 1] * d[i] > 0 else 0.0 for i in range(1, n - 1)], d[-1]]
    for i in range(n - 1):
        if d[i] == 0:
            m[i] = m[i + 1] = 0.0
        else:
            s = math.hypot(m[i] / d[i], m[i + 1] / d[i])
            if s > 3:
                m[i], m[i + 1] = 3 * m[i] / s, 3 * m[i + 1] / s

    def f(v: Column) -> Column:
        u = v / float(M)
        out = F.when(u <= xs[0], ys[0])
        for i in range(n - 1):
            h = max(xs[i + 1] - xs[i], 1e-12)
            t = (u - xs[i]) / h
            value = ys[i] + t * (h * m[i] + t * (3 * (ys[i + 1] - ys[i]) - h * (2 * m[i] + m[i + 1]) + t * (h * (m[i] + m[i + 1]) - 2 * (ys[i + 1] - ys[i]))))
            out = out.when(u <= xs[i + 1], value)
        return from_unit(out.otherwise(ys[-1]))

    return each(df, f)


def solarize(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return each(df, lambda v: F.when(v > threshold * M, M - v).otherwise(v))


def sepia(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    t = min(max(threshold, 0.0), 1.0)
    #: The sepia matrix.
    w = [(0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131)]
    mixed = [F.col("r") * k[0] + F.col("g") * k[1] + F.col("b") * k[2] for k in w]
    # the last digits of the sums are rounded away, so that exact halves go up
    return put(df, *[q16(F.round(F.col(c) + (s - F.col(c)) * t, 9)) for c, s in zip(RGB, mixed, strict=True)])


def colorize(df: DataFrame, r: float, g: float, b: float, amount: float = 0.5) -> DataFrame:
    """Towards a colour given in bytes."""
    t = min(max(amount, 0.0), 1.0)
    return put(df, *[q16(F.col(c) * (1 - t) + k / 255.0 * M * t) for c, k in zip(RGB, (r, g, b), strict=True)])


def sigmoidal_contrast(df: DataFrame, contrast: float, midpoint: float = 0.5, sharpen: bool = True) -> DataFrame:
    """On the 8-bit value, as a 256-step curve."""
    low, high = (1 / (1 + math.exp(contrast * (midpoint - e))) for e in (0.0, 1.0))

    def f(v: Column) -> Column:
        u = to_byte(v) / 255.0
        if sharpen:
            return from_unit((1 / (F.exp((midpoint - u) * contrast) + 1) - low) / (high - low))
        s = u * (high - low) + low
        inside = (s > 0) & (s < 1)
        return from_unit(F.when(inside, midpoint - F.log(1 / F.when(inside, s).otherwise(0.5) - 1) / contrast).otherwise(u))

    return each(df, f)


def levelize(df: DataFrame, black: float, white: float, gamma: float = 1.0) -> DataFrame:
    return each(df, lambda v: t16(F.pow(v / float(M), F.lit(1 / gamma)) * (white - black) + black))


def level_colors(df: DataFrame, black: Sequence[float], white: Sequence[float]) -> DataFrame:
    return put(df, *[t16((F.col(c) / float(M) * (w - k) + k) * float(M)) for c, k, w in zip(RGB, black, white, strict=True)])


def cdl(df: DataFrame, slope: Sequence[float], offset: Sequence[float], power: Sequence[float], saturation: float = 1.0) -> DataFrame:
    """[t] Slope, offset and power for each channel, then saturation."""
    v = [F.pow(clamp(unit(c) * s + o, 0, 1), F.lit(float(p))) for c, s, o, p in zip(RGB, slope, offset, power, strict=True)]
    if saturation != 1:
        lum = v[0] * 0.2126 + v[1] * 0.7152 + v[2] * 0.0722
        v = [lum + (x - lum) * saturation for x in v]
    return put(df, *[t16(x * float(M)) for x in v])


def split_toning(df: DataFrame, shadow: Sequence[int], highlight: Sequence[int], balance: float = 0.5, strength: float = 0.3) -> DataFrame:
    lum = luma() / float(M)
    low = F.greatest(F.lit(0.0), 1 - lum / balance) * strength
    high = F.greatest(F.lit(0.0), (lum - balance) / (1 - balance)) * strength
    return put(df, *[t16(F.col(c) + (s - F.col(c)) * low + (h - F.col(c)) * high) for c, s, h in zip(RGB, shadow, highlight, strict=True)])


def gradient_map(df: DataFrame, stops: Sequence[tuple[float, int, int, int]]) -> DataFrame:
    """[t] Luma through a piecewise linear gradient of (position, r, g, b)."""
    s = sorted(stops)
    t = luma() / float(M)

    def f(k: int) -> Column:
        out = F.when(t <= s[0][0], float(s[0][k]))
        for a, b in zip(s, s[1:], strict=False):
            out = out.when(t <= b[0], a[k] + (t - a[0]) / max(b[0] - a[0], 1e-12) * (b[k] - a[k]))
        return t16(out.otherwise(float(s[-1][k])))

    return put(df, f(1), f(2), f(3))


def duotone(df: DataFrame, dark: Sequence[int], light: Sequence[int]) -> DataFrame:
    return gradient_map(df, [(0.0, *dark), (1.0, *light)])


def channel_mixer(df: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """[t] 3 x 3 on channel values."""
    return put(df, *[t16(F.col("r") * m[0] + F.col("g") * m[1] + F.col("b") * m[2]) for m in matrix])


def photo_filter(df: DataFrame, r: int, g: int, b: int, density: float = 0.25) -> DataFrame:
    """[t] Multiplied by a colour at a density, at the luma it had."""
    v = [F.col(c) * (1 - density) + F.col(c) * (k / M) * density for c, k in zip(RGB, (r, g, b), strict=True)]
    new = v[0] * 0.2126 + v[1] * 0.7152 + v[2] * 0.0722
    scale = F.when(new > 0, luma() / new).otherwise(1.0)
    return put(df, *[t16(x * scale) for x in v])


def blue_shift(df: DataFrame, factor: float = 1.5) -> DataFrame:
    low, high = F.least(*RGB), F.greatest(*RGB)
    return put(df, *[q16(((F.col(c) + low * factor) * 0.5 + high * factor) * 0.5) for c in RGB])


def tint(df: DataFrame, r: int, g: int, b: int, blend: Sequence[float] = (100.0, 100.0, 100.0)) -> DataFrame:
    """[q] A tint vector, strongest at middle values."""
    mean = (r + g + b) / 3.0
    return put(df, *[q16(F.col(c) + (1 - F.pow(F.col(c) / float(M) - 0.5, F.lit(2.0)) * 4) * (k * t / 100.0 - mean)) for c, k, t in zip(RGB, blend, (r, g, b), strict=True)])


def soft_proof(df: DataFrame, ink_limit: float = 3.0, black_point: float = 1.0) -> DataFrame:
    """Through CMYK with under-colour removal and a limit on total ink."""
    cmy = [1 - unit(c) for c in RGB]
    k = F.least(*cmy) * black_point
    rest = [x - k for x in cmy]
    total = rest[0] + rest[1] + rest[2] + k
    scale = F.when(total > ink_limit, ink_limit / total).otherwise(1.0)
    return put(df, *[from_unit(clamp(1 - (x + k) * scale, 0, 1)) for x in rest])


def cycle_colormap(df: DataFrame, displacement: float) -> DataFrame:
    return each(df, lambda v: F.pmod(v + int(displacement * M), F.lit(M + 1)))


# --- thresholds and selections ------------------------------------------------------------------------------------------------------


def binary_threshold(df: DataFrame, threshold: float) -> DataFrame:
    return each(df, lambda v: F.when(v >= threshold * M, M).otherwise(0), alpha=True)


def black_threshold(df: DataFrame, threshold: float) -> DataFrame:
    return each(df, lambda v: F.when(v < threshold * M, 0).otherwise(v))


def white_threshold(df: DataFrame, threshold: float) -> DataFrame:
    return each(df, lambda v: F.when(v > threshold * M, M).otherwise(v))


def range_threshold(df: DataFrame, hard_low: float, soft_low: float, soft_high: float, hard_high: float) -> DataFrame:
    """[q] A trapezoid on 0.299 luma with four knees."""
    t = luma("601 double") / float(M)
    up, down = max(soft_low - hard_low, 1e-12), max(hard_high - soft_high, 1e-12)
    v = F.when((t < hard_low) | (t > hard_high), 0.0).when(t < soft_low, (t - hard_low) / up).when(t > soft_high, (hard_high - t) / down).otherwise(1.0)
    return all_of(df, from_unit(v))


def color_threshold(df: DataFrame, start: Sequence[float], stop: Sequence[float]) -> DataFrame:
    ok = F.lit(True)
    for c, a, b in zip(RGB, start, stop, strict=True):
        ok = ok & unit(c).between(float(a), float(b))
    return all_of(df, F.when(ok, M).otherwise(0))


def random_threshold(df: DataFrame, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """A seeded threshold for each pixel, from a hash of its place."""
    t = F.pmod(F.xxhash64("image_id", "y", "x", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24) * (high - low) + low
    return each(df, lambda v: F.when(v >= t * M, M).otherwise(0))


def bayer(n: int) -> list[list[int]]:
    if n == 1:
        return [[0]]
    half = bayer(n // 2)
    return [[4 * half[y % (n // 2)][x % (n // 2)] + (0, 2, 3, 1)[2 * (y // (n // 2)) + x // (n // 2)] for x in range(n)] for y in range(n)]


def ordered_dither(df: DataFrame, order: int = 4, n: int = 2) -> DataFrame:
    """Bayer matrix by place, ``n`` output levels, half to even."""
    flat = F.array(*[F.lit((v + 0.5) / order**2 - 0.5) for row in bayer(order) for v in row])
    shift = F.element_at(flat, (F.col("y") % order * order + F.col("x") % order + 1).cast("int"))
    step = 1.0 / (n - 1)
    return each(df, lambda v: from_unit(clamp(F.bround((v / float(M) + shift * step) / step) * step, 0, 1)))


def squared_distance(r: int, g: int, b: int) -> Column:
    return sum(((F.col(c).cast("double") - k) * (F.col(c).cast("double") - k) for c, k in zip(("g", "b"), (g, b), strict=True)), (F.col("r").cast("double") - r) * (F.col("r").cast("double") - r))


def opaque_paint(df: DataFrame, target: Sequence[int], fill: Sequence[int], fuzz: float = 0, inverted: bool = False) -> DataFrame:
    hit = squared_distance(*target) <= fuzz * fuzz
    hit = ~hit if inverted else hit
    return put(df, *[F.when(hit, k).otherwise(F.col(c)) for c, k in zip(RGB, fill, strict=True)])


def transparent_paint(df: DataFrame, target: Sequence[int], fuzz: float = 0, opacity: int = 0, inverted: bool = False) -> DataFrame:
    hit = squared_distance(*target) <= fuzz * fuzz
    return df.withColumn("a", F.when(~hit if inverted else hit, opacity).otherwise(F.coalesce("a", F.lit(M))))


def make_transparent(df: DataFrame, target: Sequence[int], fuzz: float = 0.05) -> DataFrame:
    return df.withColumn("a", F.when(squared_distance(*target) <= 3 * (fuzz * M) ** 2, 0).otherwise(F.coalesce("a", F.lit(M))))


def chroma_key(df: DataFrame, key: Sequence[int], tolerance: float = 0.15) -> DataFrame:
    """[t] Alpha rises with the distance from the key colour up to the tolerance."""
    d = squared_distance(*key) / float(M) / M
    limit = tolerance * tolerance
    return df.withColumn("a", F.when(d < limit, t16(F.sqrt(d / limit) * float(M))).otherwise(M))


def color_range(df: DataFrame, target: Sequence[int], percent: float = 10.0) -> DataFrame:
    """A mask: white within a share of the longest colour distance."""
    limit = percent / 100.0 * math.sqrt(3.0) * M
    return all_of(df, F.when(F.sqrt(squared_distance(*target)) <= limit, M).otherwise(0))


# --- alpha and channels -------------------------------------------------------------------------------------------------------------


def extract_alpha(df: DataFrame) -> DataFrame:
    return all_of(df, F.coalesce("a", F.lit(M))).withColumn("a", F.lit(None).cast("int"))


def remove_alpha(df: DataFrame, background: Sequence[int] = (M, M, M)) -> DataFrame:
    """Blend over a background, half to even; no alpha afterwards."""
    t = F.coalesce("a", F.lit(M)) / float(M)
    out = put(df, *[F.bround(F.col(c) * t + (1 - t) * k).cast("int") for c, k in zip(RGB, background, strict=True)])
    return out.withColumn("a", F.lit(None).cast("int"))


def set_alpha(df: DataFrame, value: int = M) -> DataFrame:
    return df.withColumn("a", F.lit(value))


def separate(df: DataFrame) -> DataFrame:
    """image_id, c, y, x, v: one gray image a channel."""
    return df.select("image_id", F.posexplode(F.array("r", "g", "b", "a")).alias("c", "v"), "y", "x").where(F.col("v").isNotNull())


def combine(red: DataFrame, green: DataFrame, blue: DataFrame) -> DataFrame:
    """Three gray images (image_id, y, x, v), joined by place."""
    on = ["image_id", "y", "x"]
    out = red.withColumnRenamed("v", "r").join(green.withColumnRenamed("v", "g"), on).join(blue.withColumnRenamed("v", "b"), on)
    return out.withColumn("a", F.lit(None).cast("int"))


def swap_channels(df: DataFrame, one: str, two: str) -> DataFrame:
    return df.withColumns({one: F.col(two), two: F.col(one)})


def channel_fx(df: DataFrame, text: str) -> DataFrame:
    """``red=>blue; swap:red,green``: copies and exchanges in order; unknown channels are ignored."""
    name = {"red": "r", "r": "r", "green": "g", "g": "g", "blue": "b", "b": "b", "alpha": "a", "a": "a"}
    now = {c: F.col(c) for c in "rgba"}
    for part in (p.strip().lower() for p in text.split(";")):
        if part.startswith("swap:"):
            pair = [name.get(x.strip()) for x in part[5:].split(",")]
            if len(pair) == 2 and all(pair):
                now[pair[0]], now[pair[1]] = now[pair[1]], now[pair[0]]
        elif "=>" in part:
            a, b = (name.get(x.strip()) for x in part.split("=>", 1))
            if a and b:
                now[b] = now[a]
    return df.withColumns(now)
