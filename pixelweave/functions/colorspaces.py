"""Colour spaces as Column functions on 0..1 values: each gives a list of columns. Public standard constants."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantum import M, clamp, from_unit, q16, unit

Triple = list[Column]

#: Linear sRGB to XYZ (D65), and the white point.
SRGB_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = (0.95047, 1.0, 1.08883)
#: Linear sRGB to LMS and its cube roots to Oklab.
OK_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]])
OK_LAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])
#: XYZ to cone responses; XYZ to Display P3 primaries.
XYZ_LMS = np.array([[0.7328, 0.4296, -0.1624], [-0.7036, 1.6975, 0.0061], [0.0030, 0.0136, 0.9834]])
P3_XYZ = np.array([[0.4865709486, 0.2656676932, 0.1982172852], [0.2289745641, 0.6917385218, 0.0792869141], [0.0, 0.0451133819, 1.0439443689]])
#: Luma and two chroma rows of the linear spaces.
LINEAR = {
    "ypbpr": [[0.299, 0.587, 0.114], [-0.1687367, -0.331264, 0.5], [0.5, -0.418688, -0.081312]],
    "yiq": [[0.299, 0.587, 0.114], [0.595716, -0.274453, -0.321263], [0.211456, -0.522591, 0.311135]],
    "yuv": [[0.299, 0.587, 0.114], [-0.147, -0.289, 0.436], [0.615, -0.515, -0.1]],
    "ydbdr": [[0.299, 0.587, 0.114], [-0.45, -0.883, 1.333], [-1.333, 1.116, 0.217]],
}


def decode(v: Column) -> Column:
    """sRGB to linear."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def encode(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def times(m, v: Triple) -> Triple:
    return [v[0] * float(r[0]) + v[1] * float(r[1]) + v[2] * float(r[2]) for r in m]


def inverse(m) -> np.ndarray:
    return np.linalg.inv(np.array(m, float))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Hexcone hue in 0..1; 0 for grays."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(high > low, high - low).otherwise(1.0)
    h = F.when(high == r, (g - b) / d).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.when(high <= low, 0.0).when(h < 0, h + 1).otherwise(h)


def to_hsl(r, g, b) -> Triple:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (high + low) / 2
    span = F.when(light <= 0.5, high + low).otherwise(2 - high - low)
    return [hue(r, g, b), F.when(high > low, (high - low) / F.when(span > 0, span).otherwise(1.0)).otherwise(0.0), light]


def from_hsl(h, s, light) -> Triple:
    c = (1 - F.abs(light * 2 - 1)) * s
    return [x + light - c / 2 for x in _sector(h, c)]


def _sector(h: Column, c: Column) -> Triple:
    k = F.pmod(h, F.lit(1.0)) * 6
    x = c * (1 - F.abs(k % 2 - 1))
    zero = F.lit(0.0)
    pick = lambda *v: F.when(k < 1, v[0]).when(k < 2, v[1]).when(k < 3, v[2]).when(k < 4, v[3]).when(k < 5, v[4]).otherwise(v[5])
    return [pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x)]


def to_hsv(r, g, b) -> Triple:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return [hue(r, g, b), F.when(high > 0, (high - low) / high).otherwise(0.0), high]


def from_hsv(h, s, v) -> Triple:
    c = v * s
    return [x + v - c for x in _sector(h, c)]


def to_hwb(r, g, b) -> Triple:
    return [hue(r, g, b), F.least(r, g, b), 1 - F.greatest(r, g, b)]


def from_hwb(h, w, k) -> Triple:
    v = 1 - k
    return from_hsv(h, F.when(v > 0, 1 - w / F.when(v > 0, v).otherwise(1.0)).otherwise(0.0), v)


def to_hsi(r, g, b) -> Triple:
    i = (r + g + b) / 3
    x, y = r - (g + b) / 2, (g - b) * (math.sqrt(3) / 2)
    return [F.pmod(F.atan2(y, x) / (2 * math.pi), F.lit(1.0)), F.when(i > 0, 1 - F.least(r, g, b) / i).otherwise(0.0), i]


def from_hsi(h, s, i) -> Triple:
    k = F.pmod(h, F.lit(1.0)) * 3
    f = (k - F.floor(k)) * (2 * math.pi / 3)
    low = i * (1 - s)
    high = i * (s * F.cos(f) / F.cos(math.pi / 3 - f) + 1)
    mid = i * 3 - low - high
    pick = lambda a, b, c: F.when(k < 1, a).when(k < 2, b).otherwise(c)
    return [pick(high, low, mid), pick(mid, high, low), pick(low, mid, high)]


def to_xyz(r, g, b) -> Triple:
    return times(SRGB_XYZ, [decode(v) for v in (r, g, b)])


def from_xyz(x, y, z) -> Triple:
    return [encode(v) for v in times(inverse(SRGB_XYZ), [x, y, z])]


def _cube(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)


def _uncube(t: Column) -> Column:
    return F.when(t > 6 / 29, t * t * t).otherwise((t * 116 - 16) * (27 / 24389))


def to_lab(r, g, b) -> Triple:
    fx, fy, fz = (_cube(v / w) for v, w in zip(to_xyz(r, g, b), WHITE, strict=True))
    return [fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200]


def from_lab(light, a, b) -> Triple:
    fy = (light + 16) / 116
    return from_xyz(*[_uncube(f) * w for f, w in zip((a / 500 + fy, fy, fy - b / 200), WHITE, strict=True)])


def to_luv(r, g, b) -> Triple:
    x, y, z = to_xyz(r, g, b)
    d = x + y * 15 + z * 3
    u, v = (F.when(d > 0, n / F.when(d > 0, d).otherwise(1.0)).otherwise(0.0) for n in (x * 4, y * 9))
    n = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    light = _cube(y / WHITE[1]) * 116 - 16
    return [light, light * 13 * (u - 4 * WHITE[0] / n), light * 13 * (v - 9 * WHITE[1] / n)]


def from_luv(light, u, v) -> Triple:
    n = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    y = _uncube((light + 16) / 116)
    safe = F.when(light > 0, light * 13).otherwise(1.0)
    up, vp = u / safe + 4 * WHITE[0] / n, v / safe + 9 * WHITE[1] / n
    vp = F.when(vp != 0, vp).otherwise(1.0)
    dark = light <= 0
    return from_xyz(*[F.when(dark, 0.0).otherwise(e) for e in (y * up * 9 / (vp * 4), y, y * (12 - up * 3 - vp * 20) / (vp * 4))])


def polar(a: Column, b: Column) -> tuple[Column, Column]:
    """Chroma and hue in 0..1."""
    return F.sqrt(a * a + b * b), F.pmod(F.atan2(b, a) / (2 * math.pi), F.lit(1.0))


def cartesian(c: Column, h: Column) -> tuple[Column, Column]:
    return c * F.cos(h * (2 * math.pi)), c * F.sin(h * (2 * math.pi))


def _as_polar(f: Callable) -> Callable:
    def out(r, g, b):
        light, x, y = f(r, g, b)
        return [light, *polar(x, y)]

    return out


def _of_polar(f: Callable) -> Callable:
    return lambda light, c, h: f(light, *cartesian(c, h))


def to_oklab(r, g, b) -> Triple:
    return times(OK_LAB, [F.cbrt(v) for v in times(OK_LMS, [decode(v) for v in (r, g, b)])])


def from_oklab(light, a, b) -> Triple:
    return [encode(v) for v in times(inverse(OK_LMS), [v * v * v for v in times(inverse(OK_LAB), [light, a, b])])]


def to_lms(r, g, b) -> Triple:
    return times(XYZ_LMS, to_xyz(r, g, b))


def from_lms(x, y, z) -> Triple:
    return from_xyz(*times(inverse(XYZ_LMS), [x, y, z]))


def to_p3(r, g, b) -> Triple:
    return [encode(v) for v in times(inverse(P3_XYZ), to_xyz(r, g, b))]


def from_p3(r, g, b) -> Triple:
    return from_xyz(*times(P3_XYZ, [decode(v) for v in (r, g, b)]))


def to_cmyk(r, g, b) -> Triple:
    k = 1 - F.greatest(r, g, b)
    left = F.when(k < 1, 1 - k).otherwise(1.0)
    return [*[F.when(k < 1, (1 - v - k) / left).otherwise(0.0) for v in (r, g, b)], k]


def from_cmyk(c, m, y, k) -> Triple:
    return [(1 - v) * (1 - k) for v in (c, m, y)]


def to_ycbcr(r, g, b) -> Triple:
    y, pb, pr = times(LINEAR["ypbpr"], [r, g, b])
    return [y, pb + 0.5, pr + 0.5]


def from_ycbcr(y, cb, cr) -> Triple:
    return times(inverse(LINEAR["ypbpr"]), [y, cb - 0.5, cr - 0.5])


#: Luma of the hue, chroma and luma space; D65 to D50 and back; XYZ (D50) to ProPhoto and back.
HCL_LUMA = (0.298839, 0.586811, 0.114350)
D65_D50 = [[1.0479298208, 0.0228856803, -0.0501704271], [0.0296278156, 0.9904344267, -0.0170738250], [-0.0092430581, 0.0150551442, 0.7518742814]]
D50_D65 = [[0.9555766, -0.0230393, 0.0631636], [-0.0282895, 1.0099416, 0.0210077], [0.0122982, -0.0204830, 1.3299098]]
XYZ_PROPHOTO = [[1.3459433009, -0.2556075108, -0.0511118843], [-0.5445989113, 1.5081673660, 0.0205351443], [0.0, 0.0, 1.2118127757]]
PROPHOTO_XYZ = [[0.7977604896, 0.1351917082, 0.0313493495], [0.2880711282, 0.7118432178, 0.0000856540], [0.0, 0.0, 0.8251046026]]
#: Fixed values of the perceptual quantizer and of Jzazbz (white at 203 nits).
PQ = {"c1": 0.8359375, "c2": 18.8515625, "c3": 18.6875, "n": 0.15930175781, "p": 134.034375}
JZ = {"b": 1.15, "g": 0.66, "d": -0.56, "d0": 1.6295499532821566e-11, "white": 203.0}
JZ_LMS = [[0.41478972, 0.579999, 0.0146480], [-0.20151000, 1.120649, 0.0531008], [-0.01660080, 0.264800, 0.6684799]]
LMS_JZ = [[1.9242264358, -1.0047923126, 0.0376514040], [0.3503167621, 0.7264811939, -0.0653844229], [-0.0909828110, -0.3127282905, 1.5227665613]]
JZ_IAB = [[0.5, 0.5, 0.0], [3.524000, -4.066708, 0.542708], [0.199076, 1.096799, -1.295875]]
IAB_JZ = [[1.0, 0.1386050433, 0.0580473162], [1.0, -0.1386050433, -0.0580473162], [1.0, -0.0960192421, -0.8118918960]]


def to_hcl(r, g, b) -> Triple:
    """Hexcone hue, chroma and luma."""
    return [hue(r, g, b), F.greatest(r, g, b) - F.least(r, g, b), r * HCL_LUMA[0] + g * HCL_LUMA[1] + b * HCL_LUMA[2]]


def from_hcl(h, c, light) -> Triple:
    rgb = _sector(h, c)
    m = light - (rgb[0] * HCL_LUMA[0] + rgb[1] * HCL_LUMA[1] + rgb[2] * HCL_LUMA[2])
    return [v + m for v in rgb]


def from_hclp(h, c, light) -> Triple:
    """As ``from_hcl``, but what leaves the gamut is drawn to the gray of its luma."""
    rgb = _sector(h, c)
    m = light - (rgb[0] * HCL_LUMA[0] + rgb[1] * HCL_LUMA[1] + rgb[2] * HCL_LUMA[2])
    share = F.when(m < 0, light / (light - m)).when(m + c > 1, (1 - light) / (m - light + c)).otherwise(1.0)
    low = F.when(m < 0, F.lit(0.0)).when(m + c > 1, 1 - share * c).otherwise(m)
    return [share * v + low for v in rgb]


def _pq(x: Column) -> Column:
    t = F.pow(x / 10000.0, F.lit(PQ["n"]))
    return F.when(x <= 0, 0.0).otherwise(F.pow((t * PQ["c2"] + PQ["c1"]) / (t * PQ["c3"] + 1), F.lit(PQ["p"])))


def _unpq(x: Column) -> Column:
    t = F.pow(x, F.lit(1 / PQ["p"]))
    low = t * PQ["c3"] - PQ["c2"]
    return F.when((x <= 0) | (low >= 0), 0.0).otherwise(F.pow((PQ["c1"] - t) / low, F.lit(1 / PQ["n"])) * 10000.0)


def to_jzazbz(r, g, b) -> Triple:
    """A perceptual space of absolute light; both opponent axes are halved and moved to 0..1."""
    x, y, z = [v * JZ["white"] for v in to_xyz(r, g, b)]
    i, a, b_ = times(JZ_IAB, [_pq(v) for v in times(JZ_LMS, [x * JZ["b"] - z * (JZ["b"] - 1), y * JZ["g"] - x * (JZ["g"] - 1), z])])
    return [i * (1 + JZ["d"]) / (i * JZ["d"] + 1) - JZ["d0"], a * 0.5 + 0.5, b_ * 0.5 + 0.5]


def from_jzazbz(j, a, b) -> Triple:
    i = (j + JZ["d0"]) / (1 + JZ["d"] - (j + JZ["d0"]) * JZ["d"])
    x, y, z = times(LMS_JZ, [_unpq(v) for v in times(IAB_JZ, [i, (a - 0.5) * 2, (b - 0.5) * 2])])
    x = (x + z * (JZ["b"] - 1)) / JZ["b"]
    y = (y + x * (JZ["g"] - 1)) / JZ["g"]
    return from_xyz(*[v / JZ["white"] for v in (x, y, z)])


def to_jzczhz(r, g, b) -> Triple:
    """Lightness, chroma and hue (0..1) of Jzazbz."""
    j, a, b_ = to_jzazbz(r, g, b)
    a, b_ = (a - 0.5) * 2, (b_ - 0.5) * 2
    return [j, F.sqrt(a * a + b_ * b_), F.pmod(F.atan2(b_, a) / (2 * math.pi), F.lit(1.0))]


def from_jzczhz(j, c, h) -> Triple:
    return from_jzazbz(j, c * F.cos(h * (2 * math.pi)) * 0.5 + 0.5, c * F.sin(h * (2 * math.pi)) * 0.5 + 0.5)


def to_prophoto(r, g, b) -> Triple:
    """ProPhoto RGB by way of XYZ at D50, exponent 1.8 with a linear foot."""
    linear = [clamp(v, 0, 1) for v in times(XYZ_PROPHOTO, times(D65_D50, to_xyz(r, g, b)))]
    return [F.when(v >= 1 / 512, F.pow(v, F.lit(1 / 1.8))).otherwise(v * 16.0) for v in linear]


def from_prophoto(r, g, b) -> Triple:
    linear = [F.when(v < 0, 0.0).when(v >= 16 / 512, F.pow(v, F.lit(1.8))).otherwise(v / 16.0) for v in (r, g, b)]
    return from_xyz(*times(D50_D65, times(PROPHOTO_XYZ, linear)))


SPACES: dict[str, tuple[Callable, Callable]] = {
    "hsl": (to_hsl, from_hsl),
    "hsv": (to_hsv, from_hsv),
    "hsi": (to_hsi, from_hsi),
    "hwb": (to_hwb, from_hwb),
    "xyz": (to_xyz, from_xyz),
    "lab": (to_lab, from_lab),
    "lchab": (_as_polar(to_lab), _of_polar(from_lab)),
    "luv": (to_luv, from_luv),
    "lchuv": (_as_polar(to_luv), _of_polar(from_luv)),
    "ycbcr": (to_ycbcr, from_ycbcr),
    "lms": (to_lms, from_lms),
    "oklab": (to_oklab, from_oklab),
    "oklch": (_as_polar(to_oklab), _of_polar(from_oklab)),
    "displayp3": (to_p3, from_p3),
    "hcl": (to_hcl, from_hcl),
    "hclp": (to_hcl, from_hclp),
    "jzazbz": (to_jzazbz, from_jzazbz),
    "jzczhz": (to_jzczhz, from_jzczhz),
    "prophoto": (to_prophoto, from_prophoto),
    **{name: (lambda r, g, b, m=m: times(m, [r, g, b]), lambda x, y, z, m=m: times(inverse(m), [x, y, z])) for name, m in LINEAR.items()},
}


def convert(df: DataFrame, space: str) -> DataFrame:
    """``df`` with s1, s2, s3: the pixel's coordinates in a space, as doubles."""
    s = SPACES[space.lower()][0](*[unit(c) for c in "rgb"])
    return df.withColumns({f"s{k + 1}": v for k, v in enumerate(s)})


def restore(df: DataFrame, space: str) -> DataFrame:
    """r, g, b from s1, s2, s3."""
    rgb = SPACES[space.lower()][1](F.col("s1"), F.col("s2"), F.col("s3"))
    return df.withColumns({c: from_unit(clamp(v, 0, 1)) for c, v in zip("rgb", rgb, strict=True)}).drop("s1", "s2", "s3")


def modulate(df: DataFrame, brightness: float = 100, saturation: float = 100, hue_percent: float = 100) -> DataFrame:
    """HSL lightness and saturation in percent; hue turned by (percent - 100) * 1.8 degrees."""
    h, s, light = to_hsl(*[unit(c) for c in "rgb"])
    rgb = from_hsl(F.pmod(h + (hue_percent - 100) * 1.8 / 360, F.lit(1.0)), clamp(s * (saturation / 100), 0, 1), clamp(light * (brightness / 100), 0, 1))
    # halves of a level are rounded up, whatever the last digits of the products
    return df.withColumns({c: q16(F.round(clamp(v, 0, 1) * float(M), 6)) for c, v in zip("rgb", rgb, strict=True)})
