"""Registered raster queries over the driver's tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import blend, colorspaces, drawing, generators, point
from .functions.quantum import M, to_byte, to_depth
from .operators import compare, filters, geometry, hashes, histogram, kernels, layers, neighbourhood, regions
from .plans import expression, steps
from .sources import codecs, more_codecs, rasters

KEY = ["image_id", "y", "x"]
RGB = ["r", "g", "b"]

# --- the rasters in SQL -------------------------------------------------------------------------------------------------------------

EMB = "emb AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(floor(least(greatest((CAST(embedding[i] AS DOUBLE) + 1) / 2, 0), 1) * 65535 + 0.5) AS INT) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) ix)"
PX = EMB + ", px AS (SELECT image_id // 3 AS image_id, y, x, coalesce(max(CASE WHEN image_id % 3 = 0 THEN v END), 32768) AS r, coalesce(max(CASE WHEN image_id % 3 = 1 THEN v END), 32768) AS g, coalesce(max(CASE WHEN image_id % 3 = 2 THEN v END), 32768) AS b FROM emb GROUP BY 1, 2, 3)"
PXA = EMB + ", px AS (SELECT image_id // 4 AS image_id, y, x, coalesce(max(CASE WHEN image_id % 4 = 0 THEN v END), 32768) AS r, coalesce(max(CASE WHEN image_id % 4 = 1 THEN v END), 32768) AS g, coalesce(max(CASE WHEN image_id % 4 = 2 THEN v END), 32768) AS b, coalesce(max(CASE WHEN image_id % 4 = 3 THEN v END), 32768) AS a FROM emb GROUP BY 1, 2, 3)"
#: The image that follows each one: for operators on two images.
PAIR = PX + ", nx AS (SELECT image_id - 1 AS image_id, y, x, r AS r2, g AS g2, b AS b2 FROM px), two AS (SELECT * FROM px JOIN nx USING (image_id, y, x))"
LONG = PX + ", lg AS (SELECT image_id, y, x, 0 AS c, r AS v FROM px UNION ALL SELECT image_id, y, x, 1, g FROM px UNION ALL SELECT image_id, y, x, 2, b FROM px)"
L709 = "(r::DOUBLE*0.2126 + g::DOUBLE*0.7152 + b::DOUBLE*0.0722)"
L601 = "(r::DOUBLE*0.299 + g::DOUBLE*0.587 + b::DOUBLE*0.114)"


def Q(x: str) -> str:
    return f"CAST(floor(least(greatest({x}, 0), 65535) + 0.5) AS INT)"


def T(x: str) -> str:
    return f"CAST(floor(least(greatest({x}, 0), 65535)) AS INT)"


def BYTE(x: str) -> str:
    return f"(({x} + 128 - (({x} + 128) >> 8)) >> 8)"


def _shift(df: DataFrame) -> DataFrame:
    """Each image under the id of the one before it."""
    return df.withColumn("image_id", F.col("image_id") - 1)


_GRID = "(SELECT CAST(0 AS BIGINT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range({h})) AS y) a, (SELECT unnest(range({w})) AS x) b)"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def pixels(name: str, f: Callable[[DataFrame], DataFrame], r: str, g: str | None = None, b: str | None = None, columns: list[str] | None = None) -> None:
    """A query on the colour raster; SQL of each channel, or one with {v}."""
    sql = [x.replace("{v}", c) for x, c in zip((r, g or r, b or r), RGB, strict=True)]
    register(name, lambda s, d: f(rasters.rgb(s, d)).select(*KEY, *(columns or RGB)), f"WITH {PX} SELECT image_id, y, x, {', '.join(f'{x} AS {c}' for x, c in zip(sql, columns or RGB, strict=False))} FROM px")


# --- point operators ----------------------------------------------------------------------------------------------------------------

_EVAL = {
    "add": (5000, T("{v} + 5000")), "subtract": (5000, T("{v} - 5000")), "multiply": (1.5, T("{v} * 1.5")), "divide": (1.7, T("{v} / 1.7")), "abs": (30000, T("abs({v} - 30000)")),
    "min": (32000, "CAST(least({v}, 32000) AS INT)"), "max": (32000, "CAST(greatest({v}, 32000) AS INT)"), "set": (1234, "1234"), "and": (43690, "({v} & 43690)"), "or": (255, "({v} | 255)"), "xor": (21845, "xor({v}, 21845)"),
    "leftshift": (2, "(({v} * 4) % 65536)"), "rightshift": (3, "({v} >> 3)"), "log": (10, T("ln({v} + 1.0) / ln(10.0) * 65535 / ln(65536.0)")), "pow": (2.2, T("pow({v} / 65535.0, 2.2) * 65535")),
    "cosine": (1.5, T("(cos({v} / 65535.0 * (2 * pi() * 1.5)) + 1) * 65535 / 2")), "sine": (1.5, T("(sin({v} / 65535.0 * (2 * pi() * 1.5)) + 1) * 65535 / 2")), "exponential": (0.5, T("pow(0.5, {v} / 65535.0) * 65535")), "inverselog": (10, T("(pow(10.0, {v} / 65535.0) - 1) / 9 * 65535")),
    "thresholdblack": (32000, "CASE WHEN {v} < 32000 THEN 0 ELSE {v} END"), "thresholdwhite": (33000, "CASE WHEN {v} > 33000 THEN 65535 ELSE {v} END"), "threshold": (32768, "CASE WHEN {v} > 32768 THEN 65535 ELSE 0 END"), "addmodulus": (40000, "(({v} + 40000) % 65536)"), "mean": (1, "{v}"),
}
for _op, (_k, _sql) in _EVAL.items():
    pixels(f"evaluate_{_op}", lambda d, op=_op, k=_k: point.evaluate(d, op, k), _sql)

pixels("function_polynomial", lambda d: point.apply_function(d, "polynomial", [0.5, -0.3, 0.7]), T("(((0.0 * ({v} / 65535.0) + 0.5) * ({v} / 65535.0) - 0.3) * ({v} / 65535.0) + 0.7) * 65535.0"))
pixels("function_sinusoid", lambda d: point.apply_function(d, "sinusoid", [2, 45, 0.4, 0.5]), T("(sin(({v} / 65535.0 * 2 + 0.125) * (2 * pi())) * 0.4 + 0.5) * 65535.0"))
pixels("function_arctan", lambda d: point.apply_function(d, "arctan", [5, 0.5, 1, 0.5]), T("(atan(({v} / 65535.0 - 0.5) * (pi() * 5)) * (1 / pi()) + 0.5) * 65535.0"))
pixels("brightness", lambda d: point.brightness(d, 1.3), Q("{v} / 65535.0 * 1.3 * 65535"))
pixels("contrast", lambda d: point.contrast(d, 1.5), Q("(({v} / 65535.0 - 0.5) * 1.5 + 0.5) * 65535"))
pixels("gamma", lambda d: point.gamma(d, 2.2), Q("pow({v} / 65535.0, 1 / 2.2) * 65535"))
pixels("grayscale", point.grayscale, Q(L709))
pixels("invert", point.invert, "65535 - {v}")
pixels("mean_threshold", lambda d: point.mean_threshold(d, 0.5), "CASE WHEN (r + g + b) // 3 >= 32767 THEN 65535 ELSE 0 END")
pixels("levels", lambda d: point.levels(d, 0.2, 0.8, 0.1, 0.9, 1.5), Q("(pow(least(greatest(({v} / 65535.0 - 0.2) / (0.8 - 0.2), 0), 1), 1 / 1.5) * (0.9 - 0.1) + 0.1) * 65535"))
pixels("posterize", lambda d: point.posterize(d, 5), Q("round_even({v} / 65535.0 / 0.25, 0) * 0.25 * 65535"))
pixels("saturate", lambda d: point.saturate(d, 1.6), Q(f"({L709} / 65535.0 + ({{v}} / 65535.0 - {L709} / 65535.0) * 1.6) * 65535"))
pixels("color_matrix", lambda d: point.color_matrix(d, [[0.9, 0.2, 0, 0.01], [0.1, 0.8, 0.1, 0], [0, 0.3, 0.6, 0.02]]), Q("(r/65535.0*0.9 + g/65535.0*0.2 + b/65535.0*0.0 + 0.01) * 65535"), Q("(r/65535.0*0.1 + g/65535.0*0.8 + b/65535.0*0.1 + 0.0) * 65535"), Q("(r/65535.0*0.0 + g/65535.0*0.3 + b/65535.0*0.6 + 0.02) * 65535"))
pixels("exposure", lambda d: point.exposure(d, 0.7), Q("{v} / 65535.0 * pow(2.0, 0.7) * 65535"))
pixels("vibrance", lambda d: point.vibrance(d, 0.5), T(f"{L709} + ({{v}} - {L709}) * ((1 - CASE WHEN greatest(r,g,b) > 0 THEN (greatest(r,g,b) - least(r,g,b)) / CAST(greatest(r,g,b) AS DOUBLE) ELSE 0 END) * 0.5 + 1)"))
pixels("solarize", point.solarize, "CASE WHEN {v} > 32767.5 THEN 65535 - {v} ELSE {v} END")
pixels("sepia", lambda d: point.sepia(d, 0.8), Q("r + ((r*0.393 + g*0.769 + b*0.189) - r) * 0.8"), Q("g + ((r*0.349 + g*0.686 + b*0.168) - g) * 0.8"), Q("b + ((r*0.272 + g*0.534 + b*0.131) - b) * 0.8"))
pixels("colorize", lambda d: point.colorize(d, 255, 128, 0, 0.4), Q("r * 0.6 + 65535 * 0.4"), Q("g * 0.6 + 128 / 255.0 * 65535 * 0.4"), Q("b * 0.6"))
pixels("sigmoidal_contrast", lambda d: point.sigmoidal_contrast(d, 5.0), Q(f"((1 / (exp((0.5 - {BYTE('{v}')} / 255.0) * 5.0) + 1) - 1 / (1 + exp(2.5))) / (1 / (1 + exp(-2.5)) - 1 / (1 + exp(2.5)))) * 65535"))
pixels("levelize", lambda d: point.levelize(d, 5000, 60000, 1.2), T("pow({v} / 65535.0, 1 / 1.2) * 55000 + 5000"))
pixels("level_colors", lambda d: point.level_colors(d, (0.1, 0.0, 0.2), (0.9, 1.0, 0.8)), T("(r::DOUBLE / 65535 * 0.8::DOUBLE + 0.1::DOUBLE) * 65535"), T("(g::DOUBLE / 65535) * 65535"), T("(b::DOUBLE / 65535 * (0.8::DOUBLE - 0.2::DOUBLE) + 0.2::DOUBLE) * 65535"))
pixels("cdl", lambda d: point.cdl(d, (1.1, 0.9, 1.0), (0.02, 0.0, -0.03), (1.2, 0.8, 1.0)), T("pow(least(greatest(r/65535.0*1.1 + 0.02, 0), 1), 1.2) * 65535"), T("pow(least(greatest(g/65535.0*0.9 + 0.0, 0), 1), 0.8) * 65535"), T("pow(least(greatest(b/65535.0*1.0 - 0.03, 0), 1), 1.0) * 65535"))
_LOW, _HIGH = f"greatest(0, 1 - {L709} / 65535.0 / 0.5) * 0.3", f"greatest(0, ({L709} / 65535.0 - 0.5) / 0.5) * 0.3"
pixels("split_toning", lambda d: point.split_toning(d, (0, 0, 40000), (60000, 50000, 0)), *[T(f"{c} + ({s} - {c}) * ({_LOW}) + ({h} - {c}) * ({_HIGH})") for c, s, h in zip(RGB, (0, 0, 40000), (60000, 50000, 0), strict=True)])
_L = f"{L709} / 65535.0"
pixels("duotone", lambda d: point.duotone(d, (1000, 2000, 30000), (65000, 60000, 40000)), *[T(f"{a} + ({_L} - 0.0) / 1.0 * {b - a}") for a, b in ((1000, 65000), (2000, 60000), (30000, 40000))])
pixels("gradient_map", lambda d: point.gradient_map(d, [(0.0, 0, 0, 0), (0.5, 65535, 0, 0), (1.0, 65535, 65535, 0)]), *[T(f"CASE WHEN {_L} <= 0.5 THEN {a} + {_L} / 0.5 * {m - a} ELSE {m} + ({_L} - 0.5) / 0.5 * {z - m} END") for a, m, z in ((0, 65535, 65535), (0, 0, 65535), (0, 0, 0))])
pixels("channel_mixer", lambda d: point.channel_mixer(d, [[0.5, 0.3, 0.2], [0.1, 0.7, 0.2], [0.2, 0.2, 0.6]]), *[T(f"r::DOUBLE*{a} + g::DOUBLE*{b} + b::DOUBLE*{c}") for a, b, c in ((0.5, 0.3, 0.2), (0.1, 0.7, 0.2), (0.2, 0.2, 0.6))])
pixels("blue_shift", lambda d: point.blue_shift(d, 1.5), Q("(({v} + least(r,g,b) * 1.5) * 0.5 + greatest(r,g,b) * 1.5) * 0.5"))
pixels("tint", lambda d: point.tint(d, 30000, 20000, 10000), *[Q(f"{c} + (1 - pow({c} / 65535.0 - 0.5, 2.0) * 4) * ({t} - 20000.0)") for c, t in zip(RGB, (30000.0, 20000.0, 10000.0), strict=True)])
pixels("cycle_colormap", lambda d: point.cycle_colormap(d, 0.3), "({v} + 19660) % 65536")
pixels("binary_threshold", lambda d: point.binary_threshold(d, 0.5), "CASE WHEN {v} >= 32767.5 THEN 65535 ELSE 0 END")
pixels("black_threshold", lambda d: point.black_threshold(d, 0.48), "CASE WHEN {v} < 0.48 * 65535 THEN 0 ELSE {v} END")
pixels("white_threshold", lambda d: point.white_threshold(d, 0.52), "CASE WHEN {v} > 0.52 * 65535 THEN 65535 ELSE {v} END")
_T6 = f"{L601} / 65535.0"
pixels("range_threshold", lambda d: point.range_threshold(d, 0.45, 0.48, 0.52, 0.55), Q(f"(CASE WHEN {_T6} < 0.45 OR {_T6} > 0.55 THEN 0.0 WHEN {_T6} < 0.48 THEN ({_T6} - 0.45) / (0.48::DOUBLE - 0.45::DOUBLE) WHEN {_T6} > 0.52 THEN (0.55 - {_T6}) / (0.55::DOUBLE - 0.52::DOUBLE) ELSE 1.0 END) * 65535"))
pixels("color_threshold", lambda d: point.color_threshold(d, (0.45, 0.4, 0.4), (0.55, 0.6, 0.6)), "CASE WHEN r/65535.0 BETWEEN 0.45 AND 0.55 AND g/65535.0 BETWEEN 0.4 AND 0.6 AND b/65535.0 BETWEEN 0.4 AND 0.6 THEN 65535 ELSE 0 END")
_BAYER = ", ".join(str((v + 0.5) / 16 - 0.5) for row in point.bayer(4) for v in row)
pixels("ordered_dither", lambda d: point.ordered_dither(d, 4, 2), Q(f"least(greatest(round_even(({{v}} / 65535.0 + (([{_BAYER}])[y % 4 * 4 + x % 4 + 1]) * 1.0) / 1.0, 0) * 1.0, 0), 1) * 65535"))
_D2 = "((r - 32768.0)*(r - 32768.0) + (g - 32768.0)*(g - 32768.0) + (b - 32768.0)*(b - 32768.0))"
pixels("opaque_paint", lambda d: point.opaque_paint(d, (32768, 32768, 32768), (65535, 0, 0), 6000), f"CASE WHEN {_D2} <= 36000000 THEN 65535 ELSE r END", f"CASE WHEN {_D2} <= 36000000 THEN 0 ELSE g END", f"CASE WHEN {_D2} <= 36000000 THEN 0 ELSE b END")
pixels("color_range", lambda d: point.color_range(d, (32768, 32768, 32768), 8.0), f"CASE WHEN sqrt({_D2}) <= 8.0 / 100.0 * sqrt(3.0) * 65535 THEN 65535 ELSE 0 END")
pixels("swap_channels", lambda d: point.swap_channels(d, "r", "b"), "b", "g", "r")
pixels("channel_fx", lambda d: point.channel_fx(d, "red=>green; swap:red,blue"), "b", "r", "r")
register("chroma_key", lambda s, d: point.chroma_key(rasters.rgb(s, d), (32768, 32768, 32768), 0.15).select(*KEY, "a"), f"WITH {PX} SELECT image_id, y, x, CASE WHEN {_D2} / 65535.0 / 65535 < 0.15 * 0.15 THEN CAST(floor(sqrt({_D2} / 65535.0 / 65535 / (0.15 * 0.15)) * 65535) AS INT) ELSE 65535 END AS a FROM px")
register("make_transparent", lambda s, d: point.make_transparent(rasters.rgb(s, d), (32768, 32768, 32768), 0.05).select(*KEY, "a"), f"WITH {PX} SELECT image_id, y, x, CASE WHEN {_D2} <= 3 * pow(0.05 * 65535, 2) THEN 0 ELSE 65535 END AS a FROM px")
register("remove_alpha", lambda s, d: point.remove_alpha(rasters.rgb(s, d, alpha=True)).select(*KEY, *RGB), f"WITH {PXA} SELECT image_id, y, x, {', '.join(f'CAST(round_even({c} * (a / 65535.0) + (1 - a / 65535.0) * 65535, 0) AS INT) AS {c}' for c in RGB)} FROM px")
register("extract_alpha", lambda s, d: point.extract_alpha(rasters.rgb(s, d, alpha=True)).select(*KEY, *RGB), f"WITH {PXA} SELECT image_id, y, x, a AS r, a AS g, a AS b FROM px")
register("separate_channels", lambda s, d: point.separate(rasters.rgb(s, d)), f"WITH {LONG} SELECT image_id, c, v, y, x FROM lg")
register("scale_to_depth", lambda s, d: rasters.gray(s, d).select(*KEY, to_byte("v").cast("int").alias("byte"), to_depth("v", 4).alias("nibble")), f"WITH {EMB} SELECT image_id, y, x, CAST({BYTE('v')} AS INT) AS byte, CAST(floor(v * 15.0 / 65535 + 0.5) AS INT) AS nibble FROM emb")

# --- colour spaces ------------------------------------------------------------------------------------------------------------------

def _round_trip(spark: SparkSession, sf_dir: str, space: str) -> DataFrame:
    """Pixels of each image, and how many come back from the space by more than one step (ProPhoto, whose published matrices to and fro are rounded: 1 %)."""
    df = rasters.rgb(spark, sf_dir)
    back = colorspaces.restore(colorspaces.convert(df.withColumns({f"o{c}": F.col(c) for c in RGB}), space), space)
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"o{c}")) for c in RGB]) > (655 if space == "prophoto" else 1)
    return back.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(far).cast("int").alias("wrong"))


for _name in colorspaces.SPACES:
    register(f"roundtrip_{_name}", lambda s, d, n=_name: _round_trip(s, d, n), f"WITH {PX} SELECT image_id, count(*) AS n, 0 AS wrong FROM px GROUP BY image_id")


def _space(name: str, *sql: str) -> None:
    register(f"space_{name}", lambda s, d: colorspaces.convert(rasters.rgb(s, d), name).select(*KEY, *[F.round(f"s{k}", 6).alias(f"s{k}") for k in (1, 2, 3)]), f"WITH {PX}, u AS (SELECT image_id, y, x, r/65535.0 AS r, g/65535.0 AS g, b/65535.0 AS b FROM px), hl AS (SELECT *, greatest(r,g,b) AS hi, least(r,g,b) AS lo FROM u), hh AS (SELECT *, CASE WHEN hi <= lo THEN 0.0 WHEN hi = r THEN CASE WHEN (g-b)/(hi-lo) < 0 THEN ((g-b)/(hi-lo))/6 + 1 ELSE ((g-b)/(hi-lo))/6 END WHEN hi = g THEN ((b-r)/(hi-lo)+2)/6 ELSE ((r-g)/(hi-lo)+4)/6 END AS hue FROM hl), li AS (SELECT *, {', '.join(f'CASE WHEN {c} <= 0.04045 THEN {c}/12.92 ELSE pow(({c}+0.055)/1.055, 2.4) END AS l{c}' for c in RGB)} FROM hh), xyz AS (SELECT *, lr*0.4124564+lg*0.3575761+lb*0.1804375 AS cx, lr*0.2126729+lg*0.7151522+lb*0.0721750 AS cy, lr*0.0193339+lg*0.1191920+lb*0.9503041 AS cz FROM li), lab AS (SELECT *, {', '.join(f'CASE WHEN {c}/{w} > 216.0/24389 THEN cbrt({c}/{w}) ELSE (({c}/{w})*(24389.0/27)+16)/116 END AS f{c}' for c, w in zip(('cx', 'cy', 'cz'), colorspaces.WHITE, strict=True))} FROM xyz) SELECT image_id, y, x, {', '.join(f'round({e}, 6) AS s{k + 1}' for k, e in enumerate(sql))} FROM lab")


_space("hsl", "hue", "CASE WHEN hi > lo THEN (hi-lo) / CASE WHEN (hi+lo)/2 <= 0.5 THEN hi+lo ELSE 2-hi-lo END ELSE 0 END", "(hi+lo)/2")
_space("hsv", "hue", "CASE WHEN hi > 0 THEN (hi-lo)/hi ELSE 0 END", "hi")
_space("hwb", "hue", "lo", "1-hi")
_space("xyz", "cx", "cy", "cz")
_space("lab", "fcy*116-16", "(fcx-fcy)*500", "(fcy-fcz)*200")
for _n, _m in colorspaces.LINEAR.items():
    _space(_n, *[f"r*({a}) + g*({b}) + b*({c})" for a, b, c in _m])
_space("ycbcr", *[f"r*({a}) + g*({b}) + b*({c}) + {o}" for (a, b, c), o in zip(colorspaces.LINEAR["ypbpr"], (0, 0.5, 0.5), strict=True)])
register("cmyk", lambda s, d: rasters.rgb(s, d).select(*KEY, *[F.round(v, 6).alias(n) for v, n in zip(colorspaces.to_cmyk(*[F.col(c) / float(M) for c in RGB]), "cmyk", strict=True) if n != "y"]), f"WITH {PX}, k AS (SELECT image_id, y, x, r/65535.0 AS r, g/65535.0 AS g, 1 - greatest(r,g,b)/65535.0 AS k FROM px) SELECT image_id, y, x, round(CASE WHEN k < 1 THEN (1-r-k)/(1-k) ELSE 0 END, 6) AS c, round(CASE WHEN k < 1 THEN (1-g-k)/(1-k) ELSE 0 END, 6) AS m, round(k, 6) AS k FROM k")
register("modulate", lambda s, d: colorspaces.modulate(rasters.rgb(s, d), 110, 120, 100).select(*KEY, *RGB))

# --- blending and comparing ---------------------------------------------------------------------------------------------------------

_B = {
    "multiply": "b*o", "screen": "1-(1-b)*(1-o)", "overlay": "CASE WHEN b < 0.5 THEN o*b*2 ELSE 1-(1-o)*(1-b)*2 END", "hardlight": "CASE WHEN o < 0.5 THEN b*o*2 ELSE 1-(1-b)*(1-o)*2 END",
    "softlight": "CASE WHEN o <= 0.5 THEN b-(1-o*2)*b*(1-b) ELSE b+(o*2-1)*((CASE WHEN b <= 0.25 THEN ((b*16-12)*b+4)*b ELSE sqrt(b) END)-b) END", "colordodge": "CASE WHEN b <= 0 THEN 0 WHEN o >= 1 THEN 1 ELSE least(1, b/(1-o)) END", "colorburn": "CASE WHEN b >= 1 THEN 1 WHEN o <= 0 THEN 0 ELSE 1-least(1,(1-b)/o) END",
    "linearlight": "least(greatest(b+o*2-1,0),1)", "vividlight": "CASE WHEN o <= 0.5 THEN (CASE WHEN b >= 1 THEN 1 WHEN o <= 0 THEN 0 ELSE 1-least(1,(1-b)/(o*2)) END) ELSE (CASE WHEN b <= 0 THEN 0 WHEN o*2-1 >= 1 THEN 1 ELSE least(1, b/(1-(o*2-1))) END) END", "pinlight": "CASE WHEN o < 0.5 THEN least(b,o*2) ELSE greatest(b,o*2-1) END", "hardmix": "CASE WHEN b+o >= 1 THEN 1.0 ELSE 0.0 END",
    "darken": "least(b,o)", "lighten": "greatest(b,o)", "difference": "abs(b-o)", "exclusion": "b+o-b*o*2", "add": "least(1,b+o)", "subtract": "greatest(0,b-o)", "over": "o", "plus": "least(1,b+o)", "minus": "greatest(0,b-o)", "modulusadd": "(b+o) % 1.0", "modulussubtract": "(b-o+1) % 1.0", "replace": "o", "in": "o", "out": "o", "atop": "o",
    "xor": "0", "bumpmap": "b*((r2*0.299 + g2*0.587 + b2*0.114)/65535.0)",
}


def _blended(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = rasters.rgb(spark, sf_dir)
        return blend.composite(df, _shift(df), mode).select(*KEY, *RGB)

    return run


def _word(text: str, b: str, o: str) -> str:
    import re

    return re.sub(r"\b([bo])\b", lambda m: f"({b})" if m[1] == "b" else f"({o})", text)


for _mode in blend.MODES:
    _sql = None
    if _mode in _B:
        _sql = f"WITH {PAIR} SELECT px.image_id, px.y, px.x, " + ", ".join(f"CASE WHEN r2 IS NULL THEN px.{c} ELSE {Q('(' + _word(_B[_mode], f'px.{c}/65535.0', f'{c}2/65535.0') + ')*65535')} END AS {c}" for c in RGB) + " FROM px LEFT JOIN nx USING (image_id, y, x)"
    register(f"blend_{_mode}", _blended(_mode), _sql)


def _two(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = rasters.rgb(spark, sf_dir)
        return f(df, _shift(df))

    return run


_DIFF = "(SELECT image_id, y, x, (r-r2)/65535.0 AS d0, (g-g2)/65535.0 AS d1, (b-b2)/65535.0 AS d2 FROM two)"
register("compare_measures", _two(lambda a, b: compare.measures(a, b, 0.05).select("image_id", *[F.round(c, 9).alias(c) for c in ("mse", "rmse", "psnr", "mae", "pae")], "ae")), f"WITH {PAIR}, d AS {_DIFF}, m AS (SELECT image_id, sum(d0*d0+d1*d1+d2*d2)/(count(*)*3) AS mse, sum(abs(d0)+abs(d1)+abs(d2))/(count(*)*3) AS mae, max(greatest(abs(d0),abs(d1),abs(d2))) AS pae, count(*) FILTER (WHERE d0*d0+d1*d1+d2*d2 > 0.05*0.05*3) AS ae FROM d GROUP BY image_id) SELECT image_id, round(mse,9) AS mse, round(sqrt(mse),9) AS rmse, CASE WHEN mse > 0 THEN round(log10(1/mse)*10,9) ELSE CAST('Infinity' AS DOUBLE) END AS psnr, round(mae,9) AS mae, round(pae,9) AS pae, ae FROM m")
register("compare_ssim", _two(lambda a, b: compare.ssim(a, b).select("image_id", F.round("ssim", 9).alias("ssim"))), f"WITH {PAIR}, l AS (SELECT image_id, (r*0.2126+g*0.7152+b*0.0722)/65535.0 AS p, (r2*0.2126+g2*0.7152+b2*0.0722)/65535.0 AS q FROM two), s AS (SELECT image_id, avg(p) AS mp, avg(q) AS mq, var_pop(p) AS vp, var_pop(q) AS vq, covar_pop(p,q) AS c FROM l GROUP BY image_id) SELECT image_id, round((mp*mq*2+0.0001)*(c*2+0.0009)/((mp*mp+mq*mq+0.0001)*(vp+vq+0.0009)),9) AS ssim FROM s")
register("compare_difference", _two(compare.difference), f"WITH {PAIR}, d AS (SELECT image_id, y, x, abs(r-r2) AS r, abs(g-g2) AS g, abs(b-b2) AS b FROM two), t AS (SELECT image_id, max(greatest(r,g,b)) AS top FROM d GROUP BY image_id) SELECT image_id, y, x, {', '.join(f'CASE WHEN top > 0 THEN CAST(floor({c}*65535.0/top) AS INT) ELSE 0 END AS {c}' for c in RGB)} FROM d JOIN t USING (image_id)")
for _how, _e in {"union": "greatest(r,r2)", "intersect": "least(r,r2)", "subtract": "greatest(0,r-r2)", "xor": "CAST(floor(r+r2-r*2.0*r2/65535+0.5) AS INT)"}.items():
    register(f"mask_{_how}", _two(lambda a, b, h=_how: compare.combine_masks(a, b, h)), f"WITH {PAIR} SELECT image_id, y, x, {_e} AS v FROM two")
register("anaglyph", _two(compare.anaglyph), f"WITH {PAIR} SELECT image_id, y, x, CAST(floor({L601}) AS INT) AS r, g2 AS g, b2 AS b FROM two")
register("morph", _two(lambda a, b: compare.morph(a, b, 3)), f"WITH {PAIR} SELECT image_id, CAST(f AS INT) AS frame, y, x, {', '.join(f'CAST(floor({c}*(1-f/4.0)+{c}2*(f/4.0)+0.5) AS INT) AS {c}' for c in RGB)} FROM two, (SELECT unnest([1,2,3]) AS f) q")


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.to_long(rasters.rgb(spark, sf_dir)).withColumn("z", F.col("image_id"))


for _op, _e in {"add": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "and": "bit_and(v)", "or": "bit_or(v)", "xor": "bit_xor(v)"}.items():
    register(f"evaluate_images_{_op}", lambda s, d, op=_op: compare.evaluate_images(_stack(s, d), op), f"WITH {LONG} SELECT y, x, c, {T(_e)} AS v FROM lg GROUP BY y, x, c")

# --- statistics and histograms ------------------------------------------------------------------------------------------------------


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.to_long(rasters.rgb(spark, sf_dir))


_HIST = f"h AS (SELECT image_id, c, {BYTE('v')} AS bin, count(*) AS n FROM lg GROUP BY 1, 2, 3), cdf AS (SELECT *, sum(n) OVER (PARTITION BY image_id, c ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY image_id, c) AS total FROM h)"
register("histogram", lambda s, d: histogram.histogram(_long(s, d)), f"WITH {LONG}, {_HIST} SELECT image_id, c, bin, n FROM h")
register("statistics", lambda s, d: histogram.statistics(_long(s, d)).select("image_id", "c", "n", "min", "max", *[F.round(c, 7).alias(c) for c in ("mean", "stddev", "variance", "entropy", "median")]), f"WITH {LONG}, {_HIST}, e AS (SELECT image_id, c, -sum(n/total*log2(n/total)) AS entropy, min(CASE WHEN cum >= floor(total/2) THEN bin END)/255.0 AS median FROM cdf GROUP BY 1, 2), b AS (SELECT image_id, c, count(*) AS n, min(v) AS min, max(v) AS max, avg(v/65535.0) AS mean, stddev_samp(v/65535.0) AS stddev, var_samp(v/65535.0) AS variance FROM lg GROUP BY 1, 2) SELECT image_id, c, n, min, max, round(mean,7) AS mean, round(stddev,7) AS stddev, round(variance,7) AS variance, round(entropy,7) AS entropy, round(median,7) AS median FROM b JOIN e USING (image_id, c)")
register("moments", lambda s, d: histogram.statistics(_long(s, d)).select("image_id", "c", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis")), f"WITH {LONG}, a AS (SELECT image_id, c, v/65535.0 AS u, avg(v/65535.0) OVER (PARTITION BY image_id, c) AS m FROM lg), k AS (SELECT image_id, c, avg(pow(u-m,2)) AS m2, avg(pow(u-m,3)) AS m3, avg(pow(u-m,4)) AS m4 FROM a GROUP BY 1, 2) SELECT image_id, c, CASE WHEN m2 > 0 THEN round(m3/pow(m2,1.5),6) ELSE 0 END AS skewness, CASE WHEN m2 > 0 THEN round(m4/(m2*m2)-3,6) ELSE 0 END AS kurtosis FROM k")
register("equalize", lambda s, d: histogram.equalize(_long(s, d)), f"WITH {LONG}, {_HIST}, l AS (SELECT *, min(cum) OVER (PARTITION BY image_id, c) AS least FROM cdf) SELECT lg.image_id, lg.y, lg.x, lg.c, {Q('(cum-least)/CAST(CASE WHEN total > least THEN total-least ELSE 1 END AS DOUBLE)*65535')} AS v FROM lg JOIN l ON l.image_id = lg.image_id AND l.c = lg.c AND l.bin = {BYTE('lg.v')}")
register("normalize", lambda s, d: histogram.normalize(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, e AS (SELECT image_id, min(least(r,g,b)) AS lo, max(greatest(r,g,b)) AS hi FROM px GROUP BY 1) SELECT image_id, y, x, {', '.join(f'CASE WHEN hi > lo THEN ' + Q(f'({c}-lo)/CAST(hi-lo AS DOUBLE)*65535') + f' ELSE {c} END AS {c}' for c in RGB)} FROM px JOIN e USING (image_id)")
register("auto_level", lambda s, d: histogram.auto_level(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, e AS (SELECT image_id, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in RGB)} FROM px GROUP BY 1) SELECT image_id, y, x, {', '.join(f'CASE WHEN h{c} > l{c} THEN ' + Q(f'({c}-l{c})/CAST(h{c}-l{c} AS DOUBLE)*65535') + f' ELSE {c} END AS {c}' for c in RGB)} FROM px JOIN e USING (image_id)")
register("auto_gamma", lambda s, d: histogram.auto_gamma(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, e AS (SELECT image_id, {', '.join(f'avg({c}/65535.0) AS m{c}' for c in RGB)} FROM px GROUP BY 1) SELECT image_id, y, x, {', '.join(Q(f'pow({c}/65535.0, ln(0.5)/ln(m{c}))*65535') + f' AS {c}' for c in RGB)} FROM px JOIN e USING (image_id)")
register("white_balance", lambda s, d: histogram.white_balance(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, e AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM px GROUP BY 1) SELECT image_id, y, x, {', '.join(Q(f'{c}*((mr+mg+mb)/3/m{c})') + f' AS {c}' for c in RGB)} FROM px JOIN e USING (image_id)")
register("contrast_stretch", lambda s, d: histogram.contrast_stretch(_long(s, d), 5.0, 5.0), f"WITH {LONG}, h AS (SELECT image_id, c, v AS bin, count(*) AS n FROM lg GROUP BY 1,2,3), k AS (SELECT *, sum(n) OVER (PARTITION BY image_id, c ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY image_id, c) AS total FROM h), e AS (SELECT image_id, c, min(CASE WHEN cum > total*(5.0/100) THEN bin END) AS lo, max(CASE WHEN total-cum+n > total*(5.0/100) THEN bin END) AS hi FROM k GROUP BY 1,2) SELECT image_id, y, x, c, CASE WHEN hi > lo THEN {T('(v-lo)*65535.0/(hi-lo)')} ELSE v END AS v FROM lg JOIN e USING (image_id, c)")
_LUMA_HIST = f"h AS (SELECT image_id, CAST(floor({L709}/65535.0*255+0.5) AS INT) AS bin, count(*) AS n FROM px GROUP BY 1,2), k AS (SELECT *, sum(n) OVER w AS cum, sum(bin*n) OVER w AS s, sum(n) OVER (PARTITION BY image_id) AS total, sum(bin*n) OVER (PARTITION BY image_id) AS al FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin))"
register("otsu", lambda s, d: histogram.otsu(rasters.rgb(s, d)).select("image_id", F.col("bin").cast("int").alias("bin")), f"WITH {PX}, {_LUMA_HIST}, o AS (SELECT image_id, bin, CAST(cum AS DOUBLE)*(total-cum)*(s/CAST(cum AS DOUBLE)-(al-s)/CAST(total-cum AS DOUBLE))*(s/CAST(cum AS DOUBLE)-(al-s)/CAST(total-cum AS DOUBLE)) AS bt FROM k WHERE cum < total) SELECT image_id, bin FROM (SELECT image_id, bin, row_number() OVER (PARTITION BY image_id ORDER BY bt DESC, bin) AS rn FROM o) WHERE rn = 1")
register("kapur", lambda s, d: histogram.kapur(rasters.rgb(s, d)).select("image_id", F.col("bin").cast("int").alias("bin")), f"WITH {PX}, {_LUMA_HIST}, p AS (SELECT image_id, bin, cum, total, sum(n/total*ln(n/total)) OVER (PARTITION BY image_id ORDER BY bin) AS e0, sum(n/total*ln(n/total)) OVER (PARTITION BY image_id) AS e FROM k), q AS (SELECT image_id, bin, round(ln(cum/total)-e0/(cum/total)+ln(1-cum/total)-(e-e0)/(1-cum/total),9) AS h FROM p WHERE cum < total) SELECT image_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY h DESC, bin) AS rn FROM q) WHERE rn = 1")
register("unique_colors", lambda s, d: histogram.unique_colors(rasters.rgb(s, d)), f"WITH {PX} SELECT image_id, count(DISTINCT (r,g,b)) AS colors FROM px GROUP BY 1")
register("unique_colors_image", lambda s, d: histogram.unique_colors_image(point.posterize(rasters.rgb(s, d), 9)), f"WITH {PX}, q AS (SELECT image_id, y*8+x AS pos, {', '.join(Q(f'round_even({c}/65535.0/0.125,0)*0.125*65535') + f' AS {c}' for c in RGB)} FROM px), f AS (SELECT image_id, r, g, b, min(pos) AS pos FROM q GROUP BY 1,2,3,4) SELECT image_id, 0 AS y, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1 AS INT) AS x, r, g, b FROM f")
register("tone_map_reinhard", lambda s, d: histogram.reinhard(rasters.rgb(s, d)).select(*KEY, *RGB))
register("tone_map_drago", lambda s, d: histogram.drago(rasters.rgb(s, d)).select(*KEY, *RGB))
register("match_histogram", lambda s, d: histogram.match_histogram(_long(s, d), _long(s, d).where("image_id = 0")), f"WITH {LONG}, {_HIST}, r AS (SELECT c, bin AS t, cum/total AS p FROM cdf WHERE image_id = 0) SELECT lg.image_id, lg.y, lg.x, lg.c, CAST(coalesce((SELECT min(t) FROM r WHERE r.c = cdf.c AND r.p >= cdf.cum/cdf.total), 255)*257 AS INT) AS v FROM lg JOIN cdf ON cdf.image_id = lg.image_id AND cdf.c = lg.c AND cdf.bin = {BYTE('lg.v')}")

# --- geometry -----------------------------------------------------------------------------------------------------------------------


def moved(name: str, f: Callable[[DataFrame], DataFrame], x: str, y: str, where: str = "TRUE") -> None:
    register(name, lambda s, d: f(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, r, g, b FROM px WHERE {where}")


moved("crop", lambda d: geometry.crop(d, 2, 1, 4, 5), "x-2", "y-1", "x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5")
moved("flip", geometry.flip, "x", "7-y")
moved("flop", geometry.flop, "7-x", "y")
moved("rotate_90", lambda d: geometry.rotate(d, 90), "7-y", "x")
moved("rotate_180", lambda d: geometry.rotate(d, 180), "7-x", "7-y")
moved("rotate_270", lambda d: geometry.rotate(d, 270), "y", "7-x")
moved("transpose", geometry.transpose, "y", "x")
moved("transverse", geometry.transverse, "7-y", "7-x")
moved("roll", lambda d: geometry.roll(d, 3, -2), "(x+3)%8", "(y+6)%8")
moved("shave", lambda d: geometry.shave(d, 1, 2), "x-1", "y-2", "x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 5")
moved("chop", lambda d: geometry.chop(d, 2, 3, 2, 1), "CASE WHEN x >= 4 THEN x-2 ELSE x END", "CASE WHEN y >= 4 THEN y-1 ELSE y END", "x NOT BETWEEN 2 AND 3 AND y <> 3")
_FILL = "SELECT i.image_id, CAST(yy.y AS INT) AS y, CAST(xx.x AS INT) AS x, {c} FROM (SELECT DISTINCT image_id FROM px) i, (SELECT unnest(range({h})) AS y) yy, (SELECT unnest(range({w})) AS x) xx LEFT JOIN m ON m.image_id = i.image_id AND m.y = yy.y AND m.x = xx.x"
register("splice", lambda s, d: geometry.splice(rasters.rgb(s, d), 3, 2, 2, 1).select(*KEY, *RGB), f"WITH {PX}, m AS (SELECT image_id, CASE WHEN y >= 2 THEN y+1 ELSE y END AS y, CASE WHEN x >= 3 THEN x+2 ELSE x END AS x, r, g, b FROM px) " + _FILL.format(h=9, w=10, c=", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in RGB)))
register("extent", lambda s, d: geometry.extent(rasters.rgb(s, d), 10, 6, 1, -1, (100, 200, 300, None)).select(*KEY, *RGB), f"WITH {PX}, m AS (SELECT image_id, y-1 AS y, x+1 AS x, r, g, b FROM px) " + _FILL.format(h=6, w=10, c=", ".join(f"coalesce(m.{c}, {k}) AS {c}" for c, k in zip(RGB, (100, 200, 300), strict=True))))
register("border", lambda s, d: geometry.border(rasters.rgb(s, d), 1, 2).select(*KEY, *RGB), f"WITH {PX}, m AS (SELECT image_id, y+2 AS y, x+1 AS x, r, g, b FROM px) " + _FILL.format(h=12, w=10, c=", ".join(f"coalesce(m.{c}, 65535) AS {c}" for c in RGB)))
register("tiles", lambda s, d: geometry.tiles(rasters.mosaic(s, d), 30, 50).groupBy("tile_y", "tile_x").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.sum("r").alias("r")), f"WITH {EMB}, m AS (SELECT (image_id//20)*8+y AS y, (image_id%20)*8+x AS x, v FROM emb) SELECT CAST(y//50 AS INT) AS tile_y, CAST(x//30 AS INT) AS tile_x, count(*) AS n, CAST(max(x%30) AS INT) AS x, sum(v) AS r FROM m GROUP BY 1, 2")
register("auto_orient", lambda s, d: geometry.auto_orient(rasters.rgb(s, d), (F.col("image_id") % 8 + 1)).select(*KEY, *RGB), f"WITH {PX}, o AS (SELECT *, image_id % 8 + 1 AS o FROM px) SELECT image_id, CAST(CASE o WHEN 3 THEN 7-y WHEN 4 THEN 7-y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7-x WHEN 8 THEN 7-x ELSE y END AS INT) AS y, CAST(CASE o WHEN 2 THEN 7-x WHEN 3 THEN 7-x WHEN 5 THEN y WHEN 6 THEN 7-y WHEN 7 THEN 7-y WHEN 8 THEN y ELSE x END AS INT) AS x, r, g, b FROM o")
register("sort_pixels", lambda s, d: geometry.sort_pixels(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, CAST(row_number() OVER (PARTITION BY image_id, y ORDER BY {L601}, x) - 1 AS INT) AS x, r, g, b FROM px")
register("trim", lambda s, d: geometry.trim(point.posterize(rasters.rgb(s, d), 9), 0).groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")), f"WITH {PX}, q AS (SELECT image_id, y, x, {', '.join(Q(f'round_even({c}/65535.0/0.125,0)*0.125*65535') + f' AS {c}' for c in RGB)} FROM px), f AS (SELECT image_id, r AS fr, g AS fg, b AS fb FROM q WHERE y = 0 AND x = 0), k AS (SELECT q.* FROM q JOIN f USING (image_id) WHERE r <> fr OR g <> fg OR b <> fb), z AS (SELECT image_id, CAST(max(x)-min(x)+1 AS INT) AS w, CAST(max(y)-min(y)+1 AS INT) AS h FROM k GROUP BY 1) SELECT image_id, coalesce(w, 1) AS w, coalesce(h, 1) AS h FROM f LEFT JOIN z USING (image_id)")
register("sample", lambda s, d: geometry.sample(rasters.rgb(s, d), (8, 8), (12, 5)).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, r, g, b FROM px JOIN (SELECT unnest(range(12)) AS tx) a ON least(7, CAST(floor((tx+0.5)*8/12) AS INT)) = x JOIN (SELECT unnest(range(5)) AS ty) c ON least(7, CAST(floor((ty+0.5)*8/5) AS INT)) = y")


_SINC = "CASE WHEN v < 1e-10 THEN 1 ELSE sin(pi()*v)/(pi()*v) END"
_I0 = lambda z: f"list_sum(list_transform(range(0, 30), lambda k: pow(pow(({z}) / 2, k) / factorial(CAST(k AS INT)), 2)))"
#: Each kernel at v >= 0 and where it ends, written out.
_KERNEL_SQL = {
    "triangle": ("1 - v", 1), "hermite": ("2*v*v*v - 3*v*v + 1", 1), "catrom": ("CASE WHEN v < 1 THEN 1.5*v*v*v - 2.5*v*v + 1 ELSE -0.5*v*v*v + 2.5*v*v - 4*v + 2 END", 2),
    "mitchell": ("CASE WHEN v < 1 THEN (7*v*v*v - 12*v*v + 16.0/3) / 6 ELSE (-7.0/3*v*v*v + 12*v*v - 20*v + 32.0/3) / 6 END", 2), "spline": ("CASE WHEN v < 1 THEN v*v*v/2 - v*v + 2.0/3 ELSE pow(2 - v, 3) / 6 END", 2),
    "gaussian": ("exp(-2*v*v)", 2), "sinc": (_SINC, 4), **{f"lanczos{n}": (f"CASE WHEN v < 1e-10 THEN 1 ELSE {n}*sin(pi()*v)*sin(pi()*v/{n})/(pi()*pi()*v*v) END", n) for n in (2, 3, 4, 5)},
    "hann": (f"({_SINC}) * (0.5 + 0.5*cos(pi()*v/3))", 3), "hamming": (f"({_SINC}) * (0.54 + 0.46*cos(pi()*v/3))", 3), "blackman": (f"({_SINC}) * (0.42 + 0.5*cos(pi()*v/3) + 0.08*cos(2*pi()*v/3))", 3),
    "kaiser": (f"({_SINC}) * {_I0('6.5*sqrt(greatest(0, 1 - v*v/9))')} / {_I0('6.5')}", 3), "parzen": ("CASE WHEN v < 1 THEN 1 - 1.5*v*v*(1 - 0.5*v) ELSE pow(2 - v, 3) / 8 END", 2),
    "bohman": ("(1 - v)*cos(pi()*v) + sin(pi()*v)/pi()", 1), "welch": ("1 - v*v", 1), "lagrange": ("CASE WHEN v < 1 THEN v*v*(1.5*v - 2.5) + 1 ELSE v*(v*(2.5 - 0.5*v) - 4) + 2 END", 2),
}


def _taps(source: int, target: int, method: str) -> str:
    kernel, ends = _KERNEL_SQL[method]
    scale = target / source
    places = f"SELECT CAST(o AS INT) AS o, CAST(i AS INT) AS i, CAST(abs(i - ((o + 0.5) / {scale!r} - 0.5)) * {min(scale, 1.0)!r} AS DOUBLE) AS v FROM (SELECT unnest(range({target})) AS o) a, (SELECT unnest(range({source})) AS i) b"
    return f"(SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, CASE WHEN v < {ends} THEN CAST({kernel} AS DOUBLE) ELSE 0 END AS w FROM ({places})))"


for _method in sorted({*geometry.KERNELS} - {"bilinear", "bartlett", "bicubic"}):
    register(
        f"resize_{_method}",
        lambda s, d, m=_method: geometry.resize(rasters.rgb(s, d), (8, 8), (12, 5), m).select(*KEY, *RGB),
        f"WITH {PX}, tx AS (SELECT * FROM {_taps(8, 12, _method)} t), ty AS (SELECT * FROM {_taps(8, 5, _method)} t), h AS (SELECT image_id, y, tx.o AS x, {', '.join(f'sum({c}*w) AS {c}' for c in RGB)} FROM px JOIN tx ON tx.i = x GROUP BY 1,2,3) SELECT image_id, CAST(ty.o AS INT) AS y, CAST(x AS INT) AS x, {', '.join(f'CAST(floor(least(greatest(round(sum({c}*w),6),0),65535)+0.5) AS INT) AS {c}' for c in RGB)} FROM h JOIN ty ON ty.i = y GROUP BY 1, ty.o, 3",
    )
register("area_resize", lambda s, d: geometry.area_resize(rasters.rgb(s, d), (8, 8), (4, 2)).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, CAST(y//4 AS INT) AS y, CAST(x//2 AS INT) AS x, {', '.join(f'CAST(floor(round(avg({c}),6)+0.5) AS INT) AS {c}' for c in RGB)} FROM px GROUP BY 1,2,3")
register("affine", lambda s, d: geometry.affine(rasters.rgb(s, d), (8, 8), (1.0, 0.0, 0.0, 1.0, 1.5, -0.5)).select(*KEY, *RGB))
register("swirl", lambda s, d: geometry.swirl(rasters.rgb(s, d), (8, 8), 60.0).select(*KEY, *RGB))
register("barrel", lambda s, d: geometry.barrel(rasters.rgb(s, d), (8, 8), 0.0, 0.0, 0.1, 0.9).select(*KEY, *RGB))

# --- neighbourhoods -----------------------------------------------------------------------------------------------------------------


def around(name: str, f: Callable[[DataFrame], DataFrame], value: str, radius: int = 1, clamp: bool = True, shape: str = "TRUE") -> None:
    """A window query; ``value`` aggregates {n}, the neighbour's channel (dx, dy: its offset)."""
    at = [f"least(greatest(p.{a}+d{a},0),7)" for a in "xy"] if clamp else ["p.x+dx", "p.y+dy"]
    columns = ", ".join(f"{value.replace('{n}', 'q.' + c)} AS {c}" for c in RGB)
    register(name, lambda s, d: f(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, o AS (SELECT dx, dy FROM (SELECT unnest(range(-{radius},{radius + 1})) AS dx) a, (SELECT unnest(range(-{radius},{radius + 1})) AS dy) b WHERE {shape}) SELECT p.image_id, p.y, p.x, {columns} FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = {at[0]} AND q.y = {at[1]} GROUP BY 1,2,3")


def _weights(kernel: list[list[float]]) -> str:
    n = len(kernel)
    flat = ", ".join(repr(float(w)) for row in kernel for w in row)
    return f"CAST(floor(least(greatest(round(sum({{n}}*([{flat}]::DOUBLE[])[(dy+{n // 2})*{n}+dx+{n // 2}+1]),6),0),65535)+0.5) AS INT)"


def _outer(w: list[float]) -> list[list[float]]:
    return [[a * b for b in w] for a in w]


around("gaussian_blur", lambda d: neighbourhood.gaussian_blur(d, 0.6), _weights(_outer(neighbourhood.gaussian_weights(0.6))), len(neighbourhood.gaussian_weights(0.6)) // 2)
around("box_blur", lambda d: neighbourhood.box_blur(d, 1), _weights(_outer([1 / 3] * 3)))
around("convolve", lambda d: neighbourhood.convolve(d, [[0, 0.1, 0.2], [0.1, 0.5, 0.0], [-0.1, 0, 0.2]]), _weights([[0, 0.1, 0.2], [0.1, 0.5, 0.0], [-0.1, 0, 0.2]]))
around("edge_detect", neighbourhood.edge_detect, _weights([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]]))
around("emboss", neighbourhood.emboss, _weights(neighbourhood.EMBOSS))
for _kind, _e in {"minimum": "min({n})", "maximum": "max({n})", "mean": "CAST(sum({n})//count(*) AS INT)", "median": "list_sort(list({n}))[count(*)//2+1]", "rootmeansquare": "CAST(floor(sqrt(avg(CAST({n} AS DOUBLE)*{n}))) AS INT)", "standarddeviation": "CAST(floor(stddev_pop({n})) AS INT)", "gradient": "max({n})-min({n})", "contrast": "CAST(CASE WHEN max({n})+min({n}) > 0 THEN floor((max({n})-min({n}))*65535.0/(max({n})+min({n}))) ELSE 0 END AS INT)"}.items():
    around(f"statistic_{_kind}", lambda d, k=_kind: neighbourhood.statistic(d, k, 1), _e)
register("statistic_mode", lambda s, d: neighbourhood.mode_filter(point.posterize(rasters.rgb(s, d), 9), 1).select(*KEY, *RGB))
register("statistic_nonpeak", lambda s, d: neighbourhood.statistic(rasters.rgb(s, d), "nonpeak", 1).select(*KEY, *RGB))
for _shape, _cond in {"square": "TRUE", "diamond": "abs(dx)+abs(dy) <= 1", "disk": "dx*dx+dy*dy <= 1", "cross": "dx = 0 OR dy = 0"}.items():
    around(f"erode_{_shape}", lambda d, s=_shape: neighbourhood.erode(d, neighbourhood.element(s, 1)), "min({n})", 1, False, _cond)
    around(f"dilate_{_shape}", lambda d, s=_shape: neighbourhood.dilate(d, neighbourhood.element(s, 1)), "max({n})", 1, False, _cond)
around("morphology_gradient", lambda d: neighbourhood.gradient(d, neighbourhood.element("square", 1)), "max({n})-min({n})", 1, False)
for _name, _f in {"opening": neighbourhood.opening, "closing": neighbourhood.closing, "top_hat": neighbourhood.top_hat, "bottom_hat": neighbourhood.bottom_hat}.items():
    _a, _b = ("min", "max") if _name in ("opening", "top_hat") else ("max", "min")
    _near = "JOIN {t} q ON q.image_id = p.image_id AND abs(q.x-p.x) <= 1 AND abs(q.y-p.y) <= 1 GROUP BY 1,2,3"
    _two_steps = f"WITH {PX}, s1 AS (SELECT p.image_id, p.y, p.x, {', '.join(f'{_a}(q.{c}) AS {c}' for c in RGB)} FROM px p {_near.format(t='px')}), s2 AS (SELECT p.image_id, p.y, p.x, {', '.join(f'{_b}(q.{c}) AS {c}' for c in RGB)} FROM s1 p {_near.format(t='s1')})"
    _columns = {"top_hat": "greatest(0, px.{c}-s2.{c})", "bottom_hat": "greatest(0, s2.{c}-px.{c})"}.get(_name, "s2.{c}")
    register(_name, lambda s, d, f=_f: f(rasters.rgb(s, d), neighbourhood.element("square", 1)).select(*KEY, *RGB), f"{_two_steps} SELECT s2.image_id, s2.y, s2.x, {', '.join(_columns.replace('{c}', c) + f' AS {c}' for c in RGB)} FROM s2 JOIN px USING (image_id, y, x)")
register("sobel", lambda s, d: neighbourhood.sobel(rasters.rgb(s, d)).select(*KEY, F.round("magnitude", 6).alias("magnitude")))
register("normal_map", lambda s, d: neighbourhood.normal_map(rasters.rgb(s, d)))
register("adaptive_threshold", lambda s, d: neighbourhood.adaptive_threshold(rasters.rgb(s, d), 3, 0.01).select(*KEY, *RGB), f"WITH {PX}, m AS (SELECT p.image_id, p.y, p.x, {', '.join(f'sum(q.{c}) // count(*) AS m{c}' for c in RGB)} FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x-p.x) <= 1 AND abs(q.y-p.y) <= 1 GROUP BY 1,2,3) SELECT image_id, y, x, {', '.join(f'CASE WHEN {c} >= greatest(m{c} - 655, 0) THEN 65535 ELSE 0 END AS {c}' for c in RGB)} FROM px JOIN m USING (image_id, y, x)")
register("pixelate", lambda s, d: neighbourhood.pixelate(rasters.rgb(s, d), 3).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, x, {', '.join(f'CAST(sum({c}) OVER w // count(*) OVER w AS INT) AS {c}' for c in RGB)} FROM px WINDOW w AS (PARTITION BY image_id, y//3, x//3)")

# --- hashes, regions, layers --------------------------------------------------------------------------------------------------------


def _halves(df: DataFrame) -> DataFrame:
    h = F.col("hash")
    return df.select("image_id", F.shiftrightunsigned(h, 32).alias("high"), h.bitwiseAND(0xFFFFFFFF).alias("low"))


_PACK = "CAST(sum(CASE WHEN bit AND k >= 32 THEN CAST(pow(2, k-32) AS BIGINT) ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN bit AND k < 32 THEN CAST(pow(2, k) AS BIGINT) ELSE 0 END) AS BIGINT) AS low"
register("average_hash", lambda s, d: _halves(hashes.average_hash(rasters.rgb(s, d))), f"WITH {PX}, l AS (SELECT image_id, y*8+x AS k, {L709} AS l, avg({L709}) OVER (PARTITION BY image_id) AS m FROM px), t AS (SELECT image_id, k, l >= round(m,6) AS bit FROM l) SELECT image_id, {_PACK} FROM t GROUP BY 1")
register("difference_hash", lambda s, d: _halves(hashes.difference_hash(rasters.rgb(s, d))))
register("wavelet_hash", lambda s, d: _halves(hashes.wavelet_hash(rasters.rgb(s, d))))
register("perceptual_hash", lambda s, d: _halves(hashes.perceptual_hash(rasters.rgb(s, d))))
register("similar_images", lambda s, d: hashes.similar(hashes.average_hash(rasters.rgb(s, d)), 15), f"WITH {PX}, l AS (SELECT image_id, y*8+x AS k, {L709} AS l, avg({L709}) OVER (PARTITION BY image_id) AS m FROM px), h AS (SELECT image_id, string_agg(CASE WHEN l >= round(m,6) THEN '1' ELSE '0' END, '' ORDER BY k) AS h FROM l GROUP BY 1), f AS (SELECT h, min(image_id) AS f FROM h GROUP BY 1) SELECT a.f AS a, b.f AS b, hamming(a.h, b.h) AS distance FROM f a JOIN f b ON a.f < b.f WHERE hamming(a.h, b.h) <= 15 UNION ALL SELECT f AS a, image_id AS b, 0 AS distance FROM h JOIN f USING (h) WHERE image_id <> f")
register("components", lambda s, d: regions.components(rasters.rgb(s, d), 0.5, 8).select("image_id", "label", "area", "x", "y", "w", "h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("mean_intensity", 6).alias("mean_intensity")))
register("flood_select", lambda s, d: regions.flood_select(rasters.rgb(s, d), 4, 4, 9000))
register("distance_transform", lambda s, d: regions.distance_transform(rasters.rgb(s, d)))
register("hough", lambda s, d: regions.hough(rasters.gray(s, d), (8, 8), 6, 10.0), f"WITH {EMB} SELECT image_id, CAST(round_even(x*cos(k*pi()/18)+y*sin(k*pi()/18)+sqrt(128.0),0) AS INT) AS rho, CAST(k AS INT) AS theta, count(*) AS votes FROM emb, (SELECT unnest(range(18)) AS k) t WHERE v >= 32767 GROUP BY 1,2,3 HAVING count(*) >= 6")
register("harris", lambda s, d: regions.harris(rasters.rgb(s, d)))
register("append", lambda s, d: layers.append(rasters.rgb(s, d), True, "floor(image_id / 10)").select(*KEY, *RGB), f"WITH {PX} SELECT image_id//10 AS image_id, y, CAST((image_id%10)*8+x AS INT) AS x, r, g, b FROM px")
register("montage", lambda s, d: layers.montage(rasters.rgb(s, d), 169, 13, 1).select(*KEY, *RGB), f"WITH {PX} SELECT CAST(0 AS BIGINT) AS image_id, CAST((image_id//13)*9+1+y AS INT) AS y, CAST((image_id%13)*9+1+x AS INT) AS x, r, g, b FROM px")
register("mosaic_density", lambda s, d: rasters.mosaic(s, d).groupBy("y").agg(F.sum("r").alias("r"), F.count("*").alias("n")), f"WITH {EMB} SELECT CAST((image_id//20)*8+y AS INT) AS y, sum(v) AS r, count(*) AS n FROM emb GROUP BY 1")
register("event_density", rasters.event_density, "SELECT user_id AS y, CAST(hour(ts) AS INT) AS x, count(*) AS n FROM events GROUP BY 1, 2")
register("palette", lambda s, d: kernels.palette(rasters.rgb(s, d), 4))
for _method in kernels.DIFFUSION:
    register(f"dither_{_method}", lambda s, d, m=_method: kernels.dither(rasters.rgb(s, d), m).select(*KEY, *RGB))
register("seam_carve", lambda s, d: kernels.seam_carve(rasters.rgb(s, d), 6, 7).select(*KEY, *RGB))
register("spectrum", lambda s, d: kernels.spectrum(rasters.rgb(s, d)).select(*KEY, *RGB))
register("oil_paint", lambda s, d: kernels.oil_paint(rasters.rgb(s, d), 1).select(*KEY, *RGB))

for _name, _f in {
    "bilateral": lambda d: filters.bilateral(d), "selective_blur": lambda d: filters.selective_blur(d, 0.7), "kuwahara": lambda d: filters.kuwahara(d, 1), "motion_blur": lambda d: filters.motion_blur(d, 2, 1.0, 30.0), "radial_blur": lambda d: filters.radial_blur(d, 20.0),
    "wavelet_denoise": lambda d: filters.wavelet_denoise(d, 0.02), "clahe": lambda d: filters.clahe(d, 2, 2), "canny": lambda d: filters.canny(d, 0.6, 0.05, 0.1), "mean_shift": lambda d: filters.mean_shift(d, 2), "vignette": lambda d: filters.vignette(d), "implode": lambda d: filters.implode(d), "wave": lambda d: filters.wave(d, 1.0, 6.0), "glow": lambda d: filters.glow(d), "dehaze": lambda d: filters.dehaze(d, 0.5, 1),
}.items():
    register(_name, lambda s, d, f=_f: f(rasters.rgb(s, d)).select(*KEY, *RGB))
register("draw_rectangle", lambda s, d: drawing.paint(rasters.rgb(s, d), drawing.rectangle(s, 8, 8, 1.5, 2, 6, 5.25), (65535, 0, 0)).select(*KEY, *RGB), f"WITH {PX}, c AS (SELECT *, greatest(0, least(x+1, 6) - greatest(x, 1.5)) * greatest(0, least(y+1, 5.25) - greatest(y, 2)) AS t FROM px) SELECT image_id, y, x, {', '.join(f'CAST(floor({c}*(1-t)+t*{k}+0.5) AS INT) AS {c}' for c, k in zip(RGB, (65535, 0, 0), strict=True))} FROM c")
register("draw_polygon", lambda s, d: drawing.polygon(s, 12, 9, [(1, 1), (11, 4), (2, 8)]), f"SELECT image_id, y, x, 1.0::DOUBLE AS coverage FROM {_GRID.format(h=9, w=12)} WHERE (CASE WHEN y+0.5 >= 1 AND y+0.5 < 4 AND x+0.5 < (y+0.5-1)*(10.0/3)+1 THEN 1 ELSE 0 END + CASE WHEN y+0.5 >= 4 AND y+0.5 < 8 AND x+0.5 < (y+0.5-4)*(-9.0/4)+11 THEN 1 ELSE 0 END + CASE WHEN y+0.5 >= 1 AND y+0.5 < 8 AND x+0.5 < (y+0.5-8)*(1.0/7)+2 THEN 1 ELSE 0 END) % 2 = 1")
_SOFT = "SELECT image_id, y, x, least(cov, 1) AS coverage FROM (SELECT image_id, y, x, {cov} AS cov FROM {grid}) WHERE cov > 0"
register("draw_ellipse", lambda s, d: drawing.ellipse(s, 20, 14, 9.5, 7, 6, 4), _SOFT.format(cov="(1 - sqrt((x+0.5-9.5)*(x+0.5-9.5)/36.0::DOUBLE + (y+0.5-7)*(y+0.5-7)/16.0::DOUBLE))*4 + 0.5", grid=_GRID.format(h=14, w=20)))
_ALONG = "least(greatest(((x+0.5-2)*15 + (y+0.5-3)*8)/289.0::DOUBLE, 0), 1)"
register("draw_line", lambda s, d: drawing.line(s, 20, 14, 2, 3, 17, 11, 1.5), _SOFT.format(cov=f"1.25::DOUBLE - sqrt((x+0.5 - ({_ALONG}*15 + 2))*(x+0.5 - ({_ALONG}*15 + 2)) + (y+0.5 - ({_ALONG}*8 + 3))*(y+0.5 - ({_ALONG}*8 + 3)))", grid=_GRID.format(h=14, w=20)))

# --- generators, expressions, pipelines, codecs -------------------------------------------------------------------------------------

register("gradient", lambda s, d: rasters.gradient(s, 40, 30).select(*KEY, *RGB), f"SELECT image_id, y, x, CAST(x*65535//39 AS INT) AS r, CAST(y*65535//29 AS INT) AS g, CAST((x+y)*65535//68 AS INT) AS b FROM {_GRID.format(h=30, w=40)}")
register("checkerboard", lambda s, d: generators.checkerboard(s, 40, 30, 4).select(*KEY, *RGB), f"SELECT image_id, y, x, {', '.join(f'CASE WHEN (x//4+y//4)%2 = 0 THEN 65535 ELSE 0 END AS {c}' for c in RGB)} FROM {_GRID.format(h=30, w=40)}")
register("stripes", lambda s, d: generators.stripes(s, 20, 10, 4).select(*KEY, *RGB), f"SELECT image_id, y, x, {', '.join(f'CASE WHEN y%4 < 2 THEN 65535 ELSE 0 END AS {c}' for c in RGB)} FROM {_GRID.format(h=10, w=20)}")
register("solid", lambda s, d: generators.solid(s, 9, 7, (1, 2, 3)).select(*KEY, *RGB), f"SELECT image_id, y, x, 1 AS r, 2 AS g, 3 AS b FROM {_GRID.format(h=7, w=9)}")
register("linear_gradient", lambda s, d: generators.linear_gradient(s, 33, 9, (0, 100, 65535), (65535, 200, 0)).select(*KEY, *RGB), f"SELECT image_id, y, x, CAST(floor(((x-16.0)/32.0+0.5)*65535+0.5) AS INT) AS r, CAST(floor(((x-16.0)/32.0+0.5)*100+100+0.5) AS INT) AS g, CAST(floor(((x-16.0)/32.0+0.5)*(-65535)+65535+0.5) AS INT) AS b FROM {_GRID.format(h=9, w=33)}")
_T01 = "least(sqrt((x-15)*(x-15) + (y-15)*(y-15))/sqrt(450.0::DOUBLE), 1)"
register("radial_gradient", lambda s, d: generators.radial_gradient(s, 31, 31, (65535, 0, 0), (0, 0, 65535)).select(*KEY, *RGB), f"SELECT image_id, y, x, CAST(floor({_T01}*(-65535) + 65535 + 0.5) AS INT) AS r, 0 AS g, CAST(floor({_T01}*65535 + 0.5) AS INT) AS b FROM {_GRID.format(h=31, w=31)}")
register("value_noise", lambda s, d: generators.value_noise(s, 32, 32).select(*KEY, *RGB))
register("add_noise", lambda s, d: generators.add_noise(rasters.rgb(s, d), "gaussian").select(*KEY, *RGB))
register("apply_hald", lambda s, d: generators.apply_hald(rasters.rgb(s, d), generators.identity_hald(s, 4), 4).select(*KEY, *RGB))


def expr(name: str, text: str, sql: str) -> None:
    unit = {f"{{{c}}}": f"({c}/65535.0)" for c in RGB}
    for k, v in unit.items():
        sql = sql.replace(k, v)
    e = Q(f"({sql})*65535")
    register(f"fx_{name}", lambda s, d: expression.apply(rasters.rgb(s, d), text).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for c in RGB)} FROM px")


expr("arithmetic", "u.r * 0.5 + u.g / 2 - 0.1", "{r}*0.5 + {g}/2 - 0.1")
expr("ternary", "u.r > 0.5 && u.g <= 0.5 ? u.b : 1 - u.b", "CASE WHEN {r} > 0.5 AND {g} <= 0.5 THEN {b} ELSE 1-{b} END")
expr("power", "-2^2/8 + u.r^2^0.5", "pow(-2.0,2)/8 + pow({r}, pow(2.0,0.5))")
expr("place", "(i/w + j/h)/2", "(x/8.0 + y/8.0)/2")
expr("functions", "clamp(abs(sin(u.r*pi*4)), 0.2, 0.8) + mod(u.g, 0.1)", "least(greatest(abs(sin({r}*pi()*4)),0.2),0.8) + ({g} % 0.1)")
expr("luma", "u", "{r}*0.212656 + {g}*0.715158 + {b}*0.072186")
expr("sequence", "1; u.g; max(u.r, u.b)", "greatest({r},{b})")
register("fx_two_images", lambda s, d: expression.apply([rasters.rgb(s, d), _shift(rasters.rgb(s, d)).where("image_id >= 0")], "v.r * 0.5 + u.g * 0.5").select(*KEY, "r"), f"WITH {PAIR} SELECT image_id, y, x, CASE WHEN r2 IS NULL THEN 0 ELSE {Q('(r2/65535.0*0.5 + g/65535.0*0.5)*65535')} END AS r FROM px LEFT JOIN nx USING (image_id, y, x)")
register("steps_pipeline", lambda s, d: steps.execute(rasters.rgb(s, d), ["invert", "brightness 1.1", "crop 1 1 5 5", "flop", "grayscale"]).select(*KEY, *RGB), f"WITH {PX}, a AS (SELECT image_id, y-1 AS y, 4-(x-1) AS x, {', '.join(Q(f'(65535-{c})/65535.0*1.1*65535') + f' AS {c}' for c in RGB)} FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 5) SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {', '.join(Q(L709) + f' AS {c}' for c in RGB)} FROM a")
register("steps_halo", lambda s, d: steps.execute(rasters.rgb(s, d), ["boxblur 1", "crop 2 2 3 3"]).select(*KEY, *RGB), f"WITH {PX} SELECT p.image_id, p.y-2 AS y, p.x-2 AS x, {', '.join(f'CAST(floor(round(sum(q.{c}/9.0),6)+0.5) AS INT) AS {c}' for c in RGB)} FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x-p.x) <= 1 AND abs(q.y-p.y) <= 1 WHERE p.x BETWEEN 2 AND 4 AND p.y BETWEEN 2 AND 4 GROUP BY 1,2,3")


def _codec(kind: str, alpha: bool = False) -> Query:
    """Encode every image, decode it again by content, and give its pixels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = codecs.encode(rasters.rgb(spark, sf_dir), kind).withColumn("path", F.lit(f"x.{kind}"))
        return codecs.to_pixels(codecs.decode(files)).select(*KEY, *RGB)

    return run


for _kind in codecs.CODECS:
    _deep = _kind in ("farbfeld", "png")
    register(f"codec_{_kind}", _codec(_kind), f"WITH {PX} SELECT image_id, y, x, {', '.join((c if _deep else f'{BYTE(c)}*257') + f' AS {c}' for c in RGB)} FROM px")
for _kind in more_codecs.CODECS:
    if _kind in ("pcx", "sgi", "sun", "pix", "gif", "xpm", "tiff", "fits", "ico", "dpx", "tensor"):
        _deep = _kind in ("sgi", "tiff", "fits", "dpx", "tensor")
        register(f"codec_{_kind}", _codec(_kind), f"WITH {PX} SELECT image_id, y, x, {', '.join((c if _deep else f'{BYTE(c)}*257') + f' AS {c}' for c in RGB)} FROM px")
register("codec_wbmp", _codec("wbmp"), f"WITH {PX} SELECT image_id, y, x, {', '.join(f'CASE WHEN {L709} >= 32767.5 THEN 65535 ELSE 0 END AS {c}' for c in RGB)} FROM px")
register("codec_hdr", _codec("hdr"))
register("detect_format", lambda s, d: rasters.table(s, d, "pages").select("page_id", F.coalesce(codecs.detect(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("html").cast("binary"))), F.lit("none")).alias("format"), F.coalesce(codecs.detect(F.col("html").cast("binary")), F.lit("none")).alias("plain")), "SELECT page_id, 'png' AS format, 'none' AS plain FROM pages")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise every image, threshold it by Otsu, and give its share of foreground."""
    df = point.grayscale(rasters.rgb(spark, sf_dir))
    done = histogram.apply_otsu(histogram.normalize(df))
    return done.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("r") == M).alias("foreground"))


register("flagship", flagship)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


from . import catalog_checked, catalog_images, catalog_more  # noqa: E402,F401  registers further queries with the helpers above
