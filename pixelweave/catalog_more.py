"""More registered queries: point operators, colour spaces, warps, thresholds, marks, coordinates, generators, formats and metadata."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import EMB, KEY, L601, L709, ORACLES, PAIR, PX, PXA, QUERIES, RGB, Q, T, _shift, _taps, pixels, register
from .functions import adjust, colorspaces, drawing, noise, point
from .operators import filters, frames, geometry, hashes, histogram, neighbourhood, warp
from .sources import codecs, metadata, rasters

# --- point operators ----------------------------------------------------------------------------------------------------------------

_LIN = {c: f"CASE WHEN {c}/65535.0 <= 0.04045 THEN {c}/65535.0/12.92 ELSE pow(({c}/65535.0+0.055)/1.055, 2.4) END" for c in RGB}


def _srgb(v: str) -> str:
    v = f"least(greatest({v}, 0), 1)"
    return f"CASE WHEN {v} <= 0.0031308 THEN {v}*12.92 ELSE pow({v}, 1/2.4)*1.055 - 0.055 END"


for _kind, (_see, _move) in adjust.VISION.items():
    _sim = [Q(f"({_srgb(' + '.join(f'({_LIN[c]})*({k})' for c, k in zip(RGB, row, strict=True)))}) * 65535") for row in _see]
    pixels(f"vision_{_kind}", lambda d, k=_kind: adjust.color_blindness(d, k), *_sim)
    _lost = [f"(({c} - {s}) / 65535.0)" for c, s in zip(RGB, _sim, strict=True)]
    pixels(f"daltonize_{_kind}", lambda d, k=_kind: adjust.daltonize(d, k, 0.8), *[Q(f"least(greatest({c}/65535.0 + ({' + '.join(f'{v}*({k})' for v, k in zip(_lost, row, strict=True))}) * 0.8, 0), 1) * 65535") for c, row in zip(RGB, _move, strict=True)])

_E = f"(0.6 * exp(-(({L709}/65535.0 - 0.4)*({L709}/65535.0 - 0.4)) / (2*0.15*0.15)))"
pixels("dodge", lambda d: adjust.dodge(d, 0.6, 0.4), T(f"{{v}}/65535.0 / (1 - {_E}*0.5) * 65535"))
pixels("burn", lambda d: adjust.burn(d, 0.6, 0.4), T(f"(1 - (1 - {{v}}/65535.0) / (1 - {_E}*0.5)) * 65535"))
register("apply_clut", lambda s, d: adjust.apply_clut(rasters.rgb(s, d), rasters.gradient(s, 16, 5), (16, 5)).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, x, " + ", ".join(f"CAST({e.replace('X', f'CAST(floor({c}/65535.0*15) AS INT)').replace('Y', f'CAST(floor({c}/65535.0*4) AS INT)')} AS INT) AS {c}" for c, e in zip(RGB, ("X*65535//15", "Y*65535//4", "(X+Y)*65535//19"), strict=True)) + " FROM px")
pixels("vignette_correction", lambda d: adjust.vignette_correction(d, (8, 8), 1.2, 0.3), T("{v} / greatest(1 - greatest(0, sqrt((x-4.0)*(x-4.0)+(y-4.0)*(y-4.0))/sqrt(32.0) - 0.3)*greatest(0, sqrt((x-4.0)*(x-4.0)+(y-4.0)*(y-4.0))/sqrt(32.0) - 0.3)*1.2, 0.1)"))
register("palette_hex", lambda s, d: rasters.rgb(s, d).select(*KEY, adjust.to_hex(*[F.col(c) for c in RGB]).alias("hex")), f"WITH {PX} SELECT image_id, y, x, '#' || {' || '.join(f'printf({chr(39)}%02X{chr(39)}, CAST(floor({c}/257.0+0.5) AS INT))' for c in RGB)} AS hex FROM px")
register("fuzzy_equal", lambda s, d: _two(s, d).select(*KEY, adjust.fuzzy_equal([F.col(c) for c in RGB], [F.col(f"{c}2") for c in RGB], 9000).alias("same")), f"WITH {PAIR} SELECT image_id, y, x, (r-r2)*(r-r2)::DOUBLE + (g-g2)*(g-g2)::DOUBLE + (b-b2)*(b-b2)::DOUBLE <= 81000000 AS same FROM two")
register("set_alpha", lambda s, d: point.set_alpha(rasters.rgb(s, d), 30000).select(*KEY, *RGB, "a"), f"WITH {PX} SELECT image_id, y, x, r, g, b, 30000 AS a FROM px")
register("make_opaque", lambda s, d: point.set_alpha(rasters.rgb(s, d, alpha=True)).select(*KEY, *RGB, "a"), f"WITH {PXA} SELECT image_id, y, x, r, g, b, 65535 AS a FROM px")
register("transparent_paint", lambda s, d: point.transparent_paint(rasters.rgb(s, d), (32768, 32768, 32768), 6000).select(*KEY, "a"), f"WITH {PX} SELECT image_id, y, x, CASE WHEN (r-32768.0)*(r-32768.0) + (g-32768.0)*(g-32768.0) + (b-32768.0)*(b-32768.0) <= 36000000 THEN 0 ELSE 65535 END AS a FROM px")
register("invert_mask", lambda s, d: rasters.gray(s, d).select(*KEY, (F.lit(65535) - F.col("v")).alias("v")), f"WITH {EMB} SELECT image_id, y, x, 65535 - v AS v FROM emb")
register("scale_from_depth", lambda s, d: rasters.gray(s, d).select(*KEY, _from(4, F.shiftright("v", 12)).alias("nibble"), _from(8, F.shiftright("v", 8)).alias("byte")), f"WITH {EMB} SELECT image_id, y, x, CAST(floor((v >> 12)*65535.0/15 + 0.5) AS INT) AS nibble, CAST((v >> 8)*257 AS INT) AS byte FROM emb")


def _from(bits: int, v):
    from .functions.quantum import from_depth

    return from_depth(v, bits)


def _two(spark, sf_dir: str) -> DataFrame:
    df = rasters.rgb(spark, sf_dir)
    return df.join(_shift(df).select(*KEY, *[F.col(c).alias(f"{c}2") for c in RGB]), KEY)


register("combine_channels", lambda s, d: point.combine(*[rasters.rgb(s, d).select(*KEY, F.col(c).alias("v")) for c in RGB]).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px")
register("frequency_recombine", lambda s, d: adjust.recombine(rasters.rgb(s, d), _shift(rasters.rgb(s, d))), f"WITH {PAIR} SELECT image_id, y, x, {', '.join(f'CAST(least(greatest({c} + {c}2 - 32767, 0), 65535) AS INT) AS {c}' for c in RGB)} FROM two")
register("polynomial_of_images", lambda s, d: adjust.polynomial_of_images(rasters.rgb(s, d).withColumn("layer", F.lit(0)).unionByName(_shift(rasters.rgb(s, d)).withColumn("layer", F.lit(1))), [(0.6, 1.0), (0.5, 2.0)]).where("image_id >= 0").join(rasters.rgb(s, d).select("image_id").distinct().intersect(_shift(rasters.rgb(s, d)).select("image_id").distinct()), "image_id"), f"WITH {PAIR} SELECT image_id, y, x, {', '.join(T(f'round(({c}/65535.0*0.6 + pow({c}2/65535.0, 2)*0.5)*65535, 6)') + f' AS {c}' for c in RGB)} FROM two")

# --- colour spaces ------------------------------------------------------------------------------------------------------------------

_HUE = "CASE WHEN hi <= lo THEN 0.0 WHEN hi = r THEN CASE WHEN (g-b)/(hi-lo) < 0 THEN ((g-b)/(hi-lo))/6 + 1 ELSE ((g-b)/(hi-lo))/6 END WHEN hi = g THEN ((b-r)/(hi-lo)+2)/6 ELSE ((r-g)/(hi-lo)+4)/6 END"
_XYZ = f"u AS (SELECT image_id, y, x, r/65535.0 AS r, g/65535.0 AS g, b/65535.0 AS b, {', '.join(f'{_LIN[c]} AS l{c}' for c in RGB)} FROM px), hl AS (SELECT *, greatest(r,g,b) AS hi, least(r,g,b) AS lo, lr*0.4124564+lg*0.3575761+lb*0.1804375 AS cx, lr*0.2126729+lg*0.7151522+lb*0.0721750 AS cy, lr*0.0193339+lg*0.1191920+lb*0.9503041 AS cz FROM u)"


def _space(name: str, steps: str, *sql: str) -> None:
    register(f"space_{name}", lambda s, d: colorspaces.convert(rasters.rgb(s, d), name).select(*KEY, *[F.round(f"s{k}", 6).alias(f"s{k}") for k in (1, 2, 3)]), f"WITH {PX}, {_XYZ}{steps} SELECT image_id, y, x, {', '.join(f'round({e}, 6) AS s{k + 1}' for k, e in enumerate(sql))} FROM " + ("last" if steps else "hl"))


_space("hcl", "", _HUE, "hi - lo", "r*0.298839 + g*0.586811 + b*0.114350")
_space("hclp", "", _HUE, "hi - lo", "r*0.298839 + g*0.586811 + b*0.114350")
_PQ = lambda v: f"CASE WHEN {v} <= 0 THEN 0 ELSE pow((pow({v}/10000, 0.15930175781)*18.8515625 + 0.8359375)/(pow({v}/10000, 0.15930175781)*18.6875 + 1), 134.034375) END"
_JZ = (
    ", w AS (SELECT *, cx*203 AS ax, cy*203 AS ay, cz*203 AS az FROM hl), m AS (SELECT *, 1.15*ax - 0.15*az AS px, 0.66*ay + 0.34*ax AS py FROM w), lms AS (SELECT *, 0.41478972*px + 0.579999*py + 0.0146480*az AS l, -0.20151*px + 1.120649*py + 0.0531008*az AS mm, -0.0166008*px + 0.2648*py + 0.6684799*az AS s FROM m), "
    f"q AS (SELECT *, {_PQ('l')} AS ql, {_PQ('mm')} AS qm, {_PQ('s')} AS qs FROM lms), last AS (SELECT *, 0.5*(ql+qm) AS iz, 3.524*ql - 4.066708*qm + 0.542708*qs AS ja, 0.199076*ql + 1.096799*qm - 1.295875*qs AS jb FROM q)"
)
_J = "0.44*iz/(1 - 0.56*iz) - 1.6295499532821566e-11"
_space("jzazbz", _JZ, _J, "ja*0.5+0.5", "jb*0.5+0.5")
_space("jzczhz", _JZ, _J, "sqrt(ja*ja+jb*jb)", "CASE WHEN atan2(jb, ja) < 0 THEN atan2(jb, ja)/(2*pi()) + 1 ELSE atan2(jb, ja)/(2*pi()) END")
_D50 = ", d AS (SELECT *, 1.0479298208*cx + 0.0228856803*cy - 0.0501704271*cz AS ex, 0.0296278156*cx + 0.9904344267*cy - 0.0170738250*cz AS ey, -0.0092430581*cx + 0.0150551442*cy + 0.7518742814*cz AS ez FROM hl), last AS (SELECT *, least(greatest(1.3459433009*ex - 0.2556075108*ey - 0.0511118843*ez, 0), 1) AS pr, least(greatest(-0.5445989113*ex + 1.5081673660*ey + 0.0205351443*ez, 0), 1) AS pg, least(greatest(1.2118127757*ez, 0), 1) AS pb FROM d)"
_space("prophoto", _D50, *[f"CASE WHEN {v} >= 1/512.0 THEN pow({v}, 1/1.8) ELSE {v}*16 END" for v in ("pr", "pg", "pb")])

# --- thresholds and moments ---------------------------------------------------------------------------------------------------------

register("triangle_threshold", lambda s, d: histogram.triangle(rasters.rgb(s, d)).select("image_id", F.col("bin").cast("int").alias("bin"), "threshold"), f"WITH {PX}, h AS (SELECT image_id, CAST(floor({L709}/65535.0*255+0.5) AS INT) AS bin, count(*) AS n FROM px GROUP BY 1,2), e AS (SELECT image_id, min(bin) AS lo, max(bin) AS hi, arg_max(bin, n*1000 - bin) AS peak FROM h GROUP BY 1), g AS (SELECT image_id, CASE WHEN peak-lo < hi-peak THEN peak ELSE lo END AS x0, CASE WHEN peak-lo < hi-peak THEN hi ELSE peak END AS x1 FROM e), y AS (SELECT g.*, a.n AS y0, b.n AS y1 FROM g JOIN h a ON a.image_id = g.image_id AND a.bin = x0 JOIN h b ON b.image_id = g.image_id AND b.bin = x1), i AS (SELECT y.*, unnest(range(x0, x1+1)) AS i FROM y), f AS (SELECT i.image_id, i.i, x0, x1, round(abs(CAST((y1-y0)*i.i - (x1-x0)*coalesce(n, 0) + x1*y0 - y1*x0 AS DOUBLE)), 6) AS far FROM i LEFT JOIN h ON h.image_id = i.image_id AND h.bin = i.i), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY far DESC, i) AS rn FROM f) SELECT image_id, CAST(CASE WHEN far > 0 THEN i ELSE x0 END AS INT) AS bin, CASE WHEN x0 = x1 THEN 0.5 ELSE CASE WHEN far > 0 THEN i ELSE x0 END / 255.0 END AS threshold FROM r WHERE rn = 1")
register("linear_stretch", lambda s, d: histogram.linear_stretch(rasters.rgb(s, d), 5.0, 4.0).select(*KEY, *RGB), f"WITH {PX}, l AS (SELECT image_id, floor(0.212656*r + 0.715158*g + 0.072186*b) AS l FROM px), o AS (SELECT image_id, l, count(*) OVER (PARTITION BY image_id ORDER BY l) AS below, count(*) OVER (PARTITION BY image_id ORDER BY l DESC) AS above, count(*) OVER (PARTITION BY image_id) AS n FROM l), e AS (SELECT image_id, min(l) FILTER (below >= n*0.05) AS lo, max(l) FILTER (above >= n*0.04) AS hi FROM o GROUP BY 1) SELECT px.image_id, y, x, {', '.join(f'CAST(CASE WHEN {c} <= lo THEN 0 WHEN {c} >= hi THEN 65535 ELSE floor(({c}-lo)*(65535.0/(hi-lo))) END AS INT) AS {c}' for c in RGB)} FROM px JOIN e ON e.image_id = px.image_id")
_MOMENTS = ", ".join(f"sum(pow(x, {p})*pow(y, {q})*{L709}/65535.0) AS m{p}{q}" for p in range(4) for q in range(4) if p + q <= 3)
register("hu_moments", lambda s, d: histogram.hu_moments(rasters.rgb(s, d)).select("image_id", *[F.round(f"hu{k}", 7).alias(f"hu{k}") for k in range(1, 8)]), f"WITH {PX}, m AS (SELECT image_id, {_MOMENTS} FROM px GROUP BY 1), c AS (SELECT *, m10/m00 AS xc, m01/m00 AS yc, pow(m00, 2) AS d2, pow(m00, 2.5) AS d3 FROM m), n AS (SELECT image_id, (m20-xc*m10)/d2 AS n20, (m11-xc*m01)/d2 AS n11, (m02-yc*m01)/d2 AS n02, (m30-3*xc*m20+2*xc*xc*m10)/d3 AS n30, (m21-2*xc*m11-yc*m20+2*xc*xc*m01)/d3 AS n21, (m12-2*yc*m11-xc*m02+2*yc*yc*m10)/d3 AS n12, (m03-3*yc*m02+2*yc*yc*m01)/d3 AS n03 FROM c), k AS (SELECT *, n30+n12 AS a, n21+n03 AS b, n30-3*n12 AS s, 3*n21-n03 AS t FROM n) SELECT image_id, round(n20+n02, 7) AS hu1, round(pow(n20-n02, 2)+4*n11*n11, 7) AS hu2, round(s*s+t*t, 7) AS hu3, round(a*a+b*b, 7) AS hu4, round(s*a*(a*a-3*b*b)+t*b*(3*a*a-b*b), 7) AS hu5, round((n20-n02)*(a*a-b*b)+4*n11*a*b, 7) AS hu6, round(t*a*(a*a-3*b*b)-s*b*(3*a*a-b*b), 7) AS hu7 FROM k")
register("similar_numbers", lambda s, d: hashes.similar(rasters.table(s, d, "documents").select(F.col("doc_id").alias("image_id"), (F.length("text") % 61).cast("long").alias("hash")), 2), "WITH h AS (SELECT doc_id AS image_id, CAST(length(text) % 61 AS BIGINT) AS hash FROM documents), f AS (SELECT hash, min(image_id) AS f FROM h GROUP BY 1) SELECT a.f AS a, b.f AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM f a JOIN f b ON a.f < b.f WHERE bit_count(xor(a.hash, b.hash)) <= 2 UNION ALL SELECT f AS a, image_id AS b, 0 AS distance FROM h JOIN f USING (hash) WHERE image_id <> f")

# --- marks, coordinates, rectangles -------------------------------------------------------------------------------------------------

_MARKED = f"{PAIR}, k AS (SELECT image_id, y*8+x AS i, CAST(floor(floor(r2*0.299 + g2*0.587 + b2*0.114)*255.0/65535 + 0.5) AS INT) AS l FROM two), st AS (SELECT image_id, (l >> b) & 1 AS bit, i + (1-b)*64 AS step FROM k, (SELECT unnest([0, 1]) AS b) z), pl AS (SELECT image_id, step % 64 AS place, step % 3 AS c, arg_max(bit, step) AS bit FROM st GROUP BY 1,2,3), wd AS (SELECT image_id, place, max(bit) FILTER (c=0) AS b0, max(bit) FILTER (c=1) AS b1, max(bit) FILTER (c=2) AS b2x FROM pl GROUP BY 1,2), hid AS (SELECT two.image_id, y, x, {', '.join(f'CAST(CASE WHEN {b} IS NULL THEN {c} ELSE ({c} & 65534) | {b} END AS INT) AS {c}' for c, b in zip(RGB, ('b0', 'b1', 'b2x'), strict=True))} FROM two JOIN wd ON wd.image_id = two.image_id AND wd.place = y*8+x)"


def _hidden(spark, sf_dir: str) -> DataFrame:
    df = rasters.rgb(spark, sf_dir)
    return adjust.hide_mark(df.join(_shift(df).select("image_id").distinct(), "image_id"), _shift(df), (8, 8), (8, 8), 2)


register("hide_mark", lambda s, d: _hidden(s, d).select(*KEY, *RGB), f"WITH {_MARKED} SELECT image_id, y, x, r, g, b FROM hid")
register("find_mark", lambda s, d: adjust.find_mark(_hidden(s, d), (8, 8), (8, 8), 2), f"WITH {_MARKED}, e AS (SELECT hid.*, y*8+x AS place FROM hid), w AS (SELECT image_id, i, sum(((CASE WHEN (i+(1-b)*64) % 3 = 0 THEN r WHEN (i+(1-b)*64) % 3 = 1 THEN g ELSE b_ END) & 1) << b) AS l FROM (SELECT image_id, place, r, g, b AS b_ FROM e) e JOIN (SELECT unnest(range(64)) AS i) p ON p.i = e.place CROSS JOIN (SELECT unnest([0, 1]) AS b) z GROUP BY 1,2) SELECT image_id, CAST(i//8 AS INT) AS y, CAST(i%8 AS INT) AS x, {', '.join(f'CAST(floor(l*65535.0/255 + 0.5) AS INT) AS {c}' for c in RGB)} FROM w")
_PLACES = "SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT unnest(range(-9, 17)) AS x) a, (SELECT unnest(range(-7, 12)) AS y) b"
_MOD = lambda v, n: f"((({v} % {n}) + {n}) % {n})"
_MIRROR = lambda v, n: f"CASE WHEN {_MOD(v, 2 * n - 2)} < {n} THEN {_MOD(v, 2 * n - 2)} ELSE {2 * n - 2} - {_MOD(v, 2 * n - 2)} END"
_MAPPED = {
    "edge": ("TRUE", "least(greatest(x, 0), 6)", "least(greatest(y, 0), 4)"), "mirror": ("TRUE", _MIRROR("x", 7), _MIRROR("y", 5)), "tile": ("TRUE", _MOD("x", 7), _MOD("y", 5)),
    "horizontaltile": ("y BETWEEN 0 AND 4", _MOD("x", 7), "y"), "verticaltile": ("x BETWEEN 0 AND 6", "x", _MOD("y", 5)), "checkertile": ("(floor(x/7.0) + floor(y/5.0)) % 2 = 0", _MOD("x", 7), _MOD("y", 5)), "background": ("x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 4", "x", "y"),
}


def _read_outside(method: str):
    """What 26 x 19 places in and around a window of 7 x 5 of each image read."""

    def run(spark, sf_dir: str) -> DataFrame:
        places = spark.range(26 * 19).select((F.floor(F.col("id") / 19) - 9).cast("int").alias("x"), (F.col("id") % 19 - 7).cast("int").alias("y"))
        places = places.withColumn("m", adjust.map_coordinate(F.col("x"), F.col("y"), 7, 5, method)).select("x", "y", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
        # a few places of one window: the same for every image
        px = rasters.gray(spark, sf_dir).select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), "v")
        return px.join(F.broadcast(places), ["mx", "my"]).select("image_id", "x", "y", "mx", "my", "v")

    return run


for _method, (_when, _mx, _my) in _MAPPED.items():
    register(f"map_coordinate_{_method}", _read_outside(_method), f"WITH {EMB}, m AS (SELECT x, y, CAST(CASE WHEN {_when} THEN {_mx} END AS INT) AS mx, CAST(CASE WHEN {_when} THEN {_my} END AS INT) AS my FROM ({_PLACES})) SELECT e.image_id, m.x, m.y, mx, my, v FROM m JOIN emb e ON e.x = mx AND e.y = my")
register("rectangle_intersect", lambda s, d: rasters.table(s, d, "embeddings").select(F.col("vec_id").alias("id")).select("id", adjust.intersect([F.col("id") % 20, F.floor(F.col("id") / 20) % 20, F.lit(5), F.lit(7)], [F.lit(6), F.lit(8), F.lit(9), F.lit(4)]).alias("k")).select("id", "k.x", "k.y", "k.width", "k.height"), "WITH r AS (SELECT id, greatest(id % 20, 6) AS l, greatest(id // 20 % 20, 8) AS t, least(id % 20 + 5, 15) AS e, least(id // 20 % 20 + 7, 12) AS o FROM (SELECT vec_id AS id FROM embeddings)) SELECT id, CASE WHEN e > l AND o > t THEN l ELSE 0 END AS x, CASE WHEN e > l AND o > t THEN t ELSE 0 END AS y, CASE WHEN e > l AND o > t THEN e - l ELSE 0 END AS width, CASE WHEN e > l AND o > t THEN o - t ELSE 0 END AS height FROM r")
_A = adjust.Affine.rotation(30).then(adjust.Affine.scale(2, 0.5)).then(adjust.Affine.translation(3, -1))


def _turned(spark, sf_dir: str) -> DataFrame:
    x, y = _A.apply(F.col("x").cast("double"), F.col("y").cast("double"))
    bx, by = _A.inverse().apply(x, y)
    return rasters.gray(spark, sf_dir).select("image_id", "x", "y", F.round(x, 6).alias("ax"), F.round(y, 6).alias("ay"), F.round(bx, 6).alias("bx"), F.round(by, 6).alias("by_"))


register("affine_matrix", _turned, f"WITH {EMB} SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round((x*cos(radians(30)) - y*sin(radians(30)))*2 + 3, 6) AS ax, round((x*sin(radians(30)) + y*cos(radians(30)))*0.5 - 1, 6) AS ay, CAST(x AS DOUBLE) AS bx, CAST(y AS DOUBLE) AS by_ FROM emb")

# --- warps --------------------------------------------------------------------------------------------------------------------------


def warped(name: str, f, sx: str, sy: str, inside: str = "TRUE", size: tuple[int, int] = (8, 8), centred: bool = False, source: str = PX, at: str = "", ids: str = "px") -> None:
    """SQL of an inverse map: the source place of each output pixel from px, py, and four taps with repeated edges."""
    w, h = size
    off = "0.5" if centred else "0.0"
    tap = lambda v, n: f"least(greatest({v}, 0), {n - 1})"
    register(
        name,
        lambda s, d: f(s, d).select(*KEY, *RGB),
        f"WITH {source.replace(', px AS (', ', px AS MATERIALIZED (')}, ids AS (SELECT DISTINCT image_id FROM {ids}), g AS (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, x + {off} AS px, y + {off} AS py FROM ids, (SELECT unnest(range({h})) AS y) a, (SELECT unnest(range({w})) AS x) b), a AS (SELECT g.*, ({sx}) - {off} AS sx, ({sy}) - {off} AS sy FROM g {at}), b AS (SELECT *, {inside} AS inside, floor(sx) AS x0, floor(sy) AS y0 FROM a), t AS MATERIALIZED (SELECT b.image_id, b.y, b.x, CAST({tap('x0 + dx', 8)} AS INT) AS tx, CAST({tap('y0 + dy', 8)} AS INT) AS ty, (CASE WHEN dx = 1 THEN sx - x0 ELSE 1 - sx + x0 END) * (CASE WHEN dy = 1 THEN sy - y0 ELSE 1 - sy + y0 END) AS wt FROM b, (SELECT unnest([0, 1]) AS dx) i, (SELECT unnest([0, 1]) AS dy) j WHERE inside), v AS (SELECT t.image_id, t.y, t.x, {', '.join(f'CAST(floor(round(sum({c}*wt), 6) + 0.5) AS INT) AS {c}' for c in RGB)} FROM t JOIN px q ON q.image_id = t.image_id AND q.x = tx AND q.y = ty GROUP BY 1, 2, 3) SELECT g.image_id, g.y, g.x, {', '.join(f'coalesce(v.{c}, 0) AS {c}' for c in RGB)} FROM g LEFT JOIN v ON v.image_id = g.image_id AND v.y = g.y AND v.x = g.x",
    )


_C, _S = "cos(radians(30))", "sin(radians(30))"
warped("rotate_any", lambda s, d: warp.rotate(rasters.rgb(s, d), 30.0), f"(px-5.5)*{_C} + (py-5.5)*{_S} + 4", f"-(px-5.5)*{_S} + (py-5.5)*{_C} + 4", "sx >= 0 AND sx < 7 AND sy >= 0 AND sy < 7", (11, 11))
_K = warp.homography((1, 0, 7, 1, 8, 7, 0, 8), (0, 0, 8, 0, 8, 8, 0, 8))
warped("perspective", lambda s, d: warp.perspective(rasters.rgb(s, d), (0, 0, 8, 0, 8, 8, 0, 8), (1, 0, 7, 1, 8, 7, 0, 8), (8, 8)), *[f"({a!r}*px + {b!r}*py + {c!r}) / ({float(_K[6])!r}*px + {float(_K[7])!r}*py + 1)" for a, b, c in (map(float, _K[:3]), map(float, _K[3:6]))], centred=True)
warped("to_polar", lambda s, d: warp.to_polar(rasters.rgb(s, d)), "4 + py/8.0*sqrt(32.0)*cos(px/8.0*2*pi())", "4 + py/8.0*sqrt(32.0)*sin(px/8.0*2*pi())", centred=True)
warped("from_polar", lambda s, d: warp.from_polar(rasters.rgb(s, d)), "(CASE WHEN atan2(py-4, px-4) < 0 THEN atan2(py-4, px-4) + 2*pi() ELSE atan2(py-4, px-4) END)/(2*pi())*8", "sqrt((px-4)*(px-4)+(py-4)*(py-4))/sqrt(32.0)*8", centred=True)
_R = "sqrt((px-4)*(px-4)+(py-4)*(py-4))"
_FAR = f"(CASE WHEN {_R} < 0.001 THEN {_R} ELSE 4*tan(asin(least({_R}/4, 1)*0.6))/tan(asin(0.6)) END)"
warped("spherize", lambda s, d: warp.spherize(rasters.rgb(s, d), 0.6), f"4 + cos(atan2(py-4, px-4))*{_FAR}", f"4 + sin(atan2(py-4, px-4))*{_FAR}", "sqrt((px-4)*(px-4)+(py-4)*(py-4)) < 4")
warped("displace", lambda s, d: warp.displace(rasters.rgb(s, d), _shift(rasters.rgb(s, d)), 3.0, 2.0).join(_shift(rasters.rgb(s, d)).select("image_id").distinct(), "image_id"), "px + (n.r2 - 32767.5)/32767.5*3", "py + (n.g2 - 32767.5)/32767.5*2", source=PX + ", nx AS (SELECT image_id - 1 AS image_id, y, x, r AS r2, g AS g2 FROM px)", at="JOIN nx n ON n.image_id = g.image_id AND n.x = g.x AND n.y = g.y", ids="(SELECT image_id FROM px INTERSECT SELECT image_id FROM nx)")

# --- formats ------------------------------------------------------------------------------------------------------------------------


def _jpeg(spark, sf_dir: str, **options) -> DataFrame:
    """How many images come back from JPEG files with a mean error below 1 % of the range."""
    df = rasters.rgb(spark, sf_dir)
    files = codecs.encode(df, "jpeg", **options).withColumn("path", F.lit("x.jpg"))
    back = codecs.to_pixels(codecs.decode(files))
    far = df.join(back.select(*KEY, *[F.col(c).alias(f"{c}2") for c in RGB]), KEY).groupBy("image_id").agg(F.count("*").alias("n"), F.avg(sum(F.abs(F.col(c) - F.col(f"{c}2")) for c in RGB) / 3).alias("far"))
    return far.select("image_id", "n", (F.col("far") < 655.35).alias("near"))


for _name, _options in (("jpeg", {"quality": 100}), ("jpeg_progressive", {"quality": 100, "progressive": True})):
    register(f"codec_{_name}", lambda s, d, o=_options: _jpeg(s, d, **o), f"WITH {PX} SELECT image_id, count(*) AS n, TRUE AS near FROM px GROUP BY 1")
#: Fixed values, written out from the formats' own documents: what a file of each begins with, as text where it is some, and its name.
_BEGINNINGS = [
    ("89504E470D0A1A0A", "png"), ("FFD8FFE0", "jpeg"), ("474946383961", "gif"), ("474946383761", "gif"), ("524946460000000057454250", "webp"), ("49492A0008000000", "tiff"), ("4D4D002A00000008", "tiff"), ("424D36000000", "bmp"), ("384250530001", "psd"), ("444453207C000000", "dds"),
    ("716F696600000008", "qoi"), ("233F52414449414E43450A", "hdr"), ("233F524742450A", "hdr"), ("000001000100", "ico"), ("6661726266656C64", "farbfeld"), ("5344505800000800", "dpx"), ("5850445300080000", "dpx"), ("53494D504C4520203D", "fits"), ("802A5FD7", "cin"), ("00" * 128 + "4449434D", "dicom"),
    ("0000000C6A5020200D0A870A", "jpeg2000"), ("FF4FFF5100", "jpeg2000"), ("FF0A0000", "jxl"), ("0000000C4A584C20", "jxl"), ("000000206674797061766966", "avif"), ("762F310102000000", "exr"), ("01DA0101", "sgi"), ("59A66A95", "sun"), ("0A050108", "pcx"), ("2F2A2058504D202A2F", "xpm"), ("54454E53", "tensor"),
    ("50310A38", "pnm"), ("50320A38", "pnm"), ("50330A38", "pnm"), ("50340A38", "pnm"), ("50350A38", "pnm"), ("50360A38", "pnm"), ("3C68746D6C3E", "none"), ("0102030405", "none"),
]
_one_of = lambda values: F.element_at(F.array(*[F.lit(v) for v, _ in values]), (F.col("page_id") % len(values) + 1).cast("int"))
register(
    "probe_signatures",
    lambda s, d: rasters.table(s, d, "pages").select("page_id", F.coalesce(codecs.detect(F.concat(F.unhex(_one_of(_BEGINNINGS)), F.col("html").cast("binary"))), F.lit("none")).alias("format")),
    f"SELECT page_id, CASE page_id % {len(_BEGINNINGS)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, (_, n) in enumerate(_BEGINNINGS)) + " END AS format FROM pages",
)
#: Extensions and the formats they stand for.
_ENDINGS = [("tga", "tga"), ("WBMP", "wbmp"), ("pix", "pix"), ("Xbm", "xbm"), ("xpm", "xpm"), ("svg", "svg"), ("PDF", "pdf"), ("jpg", "jpeg"), ("jpeg", "jpeg"), ("TIF", "tiff"), ("tiff", "tiff"), ("ff", "farbfeld"), ("ppm", "pnm"), ("pgm", "pnm"), ("pbm", "pnm"), ("png", "png")]
register(
    "probe_extensions",
    lambda s, d: rasters.table(s, d, "pages").select("page_id", codecs.detect_extension(F.concat(F.col("url"), F.lit("/a.b/file."), _one_of(_ENDINGS))).alias("format")),
    f"SELECT page_id, CASE page_id % {len(_ENDINGS)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, (_, n) in enumerate(_ENDINGS)) + " END AS format FROM pages",
)

# --- metadata -----------------------------------------------------------------------------------------------------------------------


def _tagged(spark, sf_dir: str) -> DataFrame:
    """EXIF entries for each vector's id: a text, a number, rationals and bytes in three directories."""
    rows = rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    entry = lambda ifd, tag, kind, text: F.struct(F.lit(ifd).alias("ifd"), F.lit(tag).alias("tag"), F.lit(kind).alias("type"), text.alias("text"))
    i = F.col("image_id")
    entries = F.array(
        entry("ifd0", 0x010E, 2, F.concat(F.lit("vector "), i.cast("string"))),
        entry("ifd0", 0x0112, 3, (i % 8 + 1).cast("string")),
        entry("exif", 0x829A, 5, F.concat(F.lit("1/"), (i + 1).cast("string"))),
        entry("exif", 0x9000, 7, F.lit("0x30 0x32 0x33 0x32")),
        entry("gps", 2, 5, F.concat((i % 90).cast("string"), F.lit("/1, 30/1, 7/2"))),
    )
    return rows.select("image_id", F.explode(entries).alias("e")).select("image_id", "e.*")


def _files(spark, sf_dir: str) -> DataFrame:
    """A small JPEG file for each vector's id: all of the same bytes."""
    import numpy as np

    from .sources import jpeg

    return rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(bytearray(jpeg.encode(np.full((8, 8, 3), 30_000)))).alias("content"))


_ENTRIES = "SELECT vec_id AS image_id, unnest([{'ifd': 'ifd0', 'tag': 270, 'name': 'ImageDescription', 'text': 'vector ' || vec_id}, {'ifd': 'ifd0', 'tag': 274, 'name': 'Orientation', 'text': CAST(vec_id % 8 + 1 AS VARCHAR)}, {'ifd': 'exif', 'tag': 33434, 'name': 'ExposureTime', 'text': '1/' || (vec_id + 1)}, {'ifd': 'exif', 'tag': 36864, 'name': 'ExifVersion', 'text': '0x30 0x32 0x33 0x32'}, {'ifd': 'gps', 'tag': 2, 'name': 'GpsLatitude', 'text': (vec_id % 90) || '/1, 30/1, 7/2'}]) AS e FROM embeddings"
for _name, _big in (("exif_tags", False), ("exif_tags_big_endian", True)):
    register(_name, lambda s, d, b=_big: metadata.exif_tags(metadata.with_exif(_files(s, d), _tagged(s, d), b)).select("image_id", "ifd", "tag", "name", "text"), f"SELECT image_id, e.ifd AS ifd, e.tag AS tag, e.name AS name, e.text AS text FROM ({_ENTRIES})")
register("exif_first_tag", lambda s, d: metadata.first_tag(_tagged(s, d), 0x829A), "SELECT vec_id AS image_id, 'exif' AS ifd, '1/' || (vec_id + 1) AS text FROM embeddings")
register("exif_names", lambda s, d: _tagged(s, d).select("image_id", "tag", metadata.name_of(F.col("tag")).alias("name")), f"SELECT image_id, e.tag AS tag, CASE WHEN e.tag = 2 THEN '0x0002' ELSE e.name END AS name FROM ({_ENTRIES})")


def _recorded(spark, sf_dir: str) -> DataFrame:
    rows = rasters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return rows.select("image_id", F.posexplode(F.array(F.concat(F.lit("title "), F.col("image_id").cast("string")), F.lit("one"), F.lit("two"))).alias("place", "text")).select("image_id", "place", F.when(F.col("place") == 0, 5).otherwise(25).alias("data_set"), "text")


register("iptc_records", lambda s, d: metadata.iptc_records(metadata.with_iptc(_files(s, d), _recorded(s, d))), "SELECT vec_id AS image_id, CAST(p AS INT) AS place, CASE WHEN p = 0 THEN 5 ELSE 25 END AS data_set, CASE WHEN p = 0 THEN 'ObjectName' ELSE 'Keywords' END AS name, CASE p WHEN 0 THEN 'title ' || vec_id WHEN 1 THEN 'one' ELSE 'two' END AS text FROM embeddings, (SELECT unnest([0, 1, 2]) AS p) t")
register("iptc_first_value", lambda s, d: metadata.first_value(_recorded(s, d), 25), "SELECT vec_id AS image_id, 'one' AS text FROM embeddings")
register("strip_metadata", lambda s, d: _files(s, d).join(metadata.stripped(metadata.with_exif(_files(s, d), _tagged(s, d))).withColumnRenamed("content", "bare"), "image_id").select("image_id", (F.col("content") == F.col("bare")).alias("same")), "SELECT vec_id AS image_id, TRUE AS same FROM embeddings")

# --- textures -----------------------------------------------------------------------------------------------------------------------

_XY = "(SELECT CAST(0 AS BIGINT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT unnest(range({h})) AS y) a, (SELECT unnest(range({w})) AS x) b)"
_LAT = lambda x, y, seed: f"(CAST('0x' || substr(md5(CAST(CAST({x} AS BIGINT) AS VARCHAR) || ',' || CAST(CAST({y} AS BIGINT) AS VARCHAR) || ',{seed}'), 1, 6) AS INT) / 16777216.0)"


def _sql_slope(ix: str, iy: str, dx: str, dy: str, seed: int) -> str:
    turn = f"({_LAT(ix, iy, seed)} * 2 * pi())"
    return f"(cos({turn})*({dx}) + sin({turn})*({dy}))"


def _sql_perlin(x: str, y: str, seed: int = 0) -> str:
    ix, iy = f"floor({x})", f"floor({y})"
    fx, fy = f"(({x}) - {ix})", f"(({y}) - {iy})"
    u, v = (f"(6*pow({t}, 5) - 15*pow({t}, 4) + 10*pow({t}, 3))" for t in (fx, fy))
    at = lambda a, b: _sql_slope(f"{ix} + {a}", f"{iy} + {b}", f"{fx} - {a}", f"{fy} - {b}", seed)
    top, low = (f"({at(0, b)}*(1 - {u}) + {at(1, b)}*{u})" for b in (0, 1))
    return f"(({top}*(1 - {v}) + {low}*{v}) * sqrt(2.0))"


def _sql_fbm(x: str, y: str, octaves: int, persistence: float, seed: int, folded: bool) -> str:
    parts = [_sql_perlin(f"({x})*{2.0**k}", f"({y})*{2.0**k}", seed + k) for k in range(octaves)]
    return "((" + " + ".join(f"{f'abs({p})' if folded else p}*{persistence**k!r}" for k, p in enumerate(parts)) + f") / {sum(persistence**k for k in range(octaves))!r})"


def _sql_simplex(x: str, y: str, seed: int) -> str:
    skew, back = (math.sqrt(3) - 1) / 2, (3 - math.sqrt(3)) / 6
    ix, iy = (f"floor({v} + ({x} + {y})*{skew!r})" for v in (x, y))
    x0, y0 = (f"(({v}) - {i} + ({ix} + {iy})*{back!r})" for v, i in ((x, ix), (y, iy)))
    right = f"(CASE WHEN {x0} > {y0} THEN 1 ELSE 0 END)"
    total = []
    for a, b, k in (("0", "0", 0), (right, f"(1 - {right})", 1), ("1", "1", 2)):
        dx, dy = f"({x0} - {a} + {k * back!r})", f"({y0} - {b} + {k * back!r})"
        total.append(f"pow(greatest(0.5 - {dx}*{dx} - {dy}*{dy}, 0), 4) * {_sql_slope(f'{ix} + {a}', f'{iy} + {b}', dx, dy, seed)}")
    return f"(({' + '.join(total)}) * 99.2)"


def _sql_worley(x: str, y: str, seed: int) -> str:
    cells = [f"sqrt(pow(floor({x}) + {a} + {_LAT(f'floor({x}) + {a}', f'floor({y}) + {b}', seed)} - ({x}), 2) + pow(floor({y}) + {b} + {_LAT(f'floor({x}) + {a}', f'floor({y}) + {b}', seed + 1)} - ({y}), 2))" for b in (-1, 0, 1) for a in (-1, 0, 1)]
    return f"list_sort([{', '.join(cells)}])"


def textured(name: str, make, r: str, g: str | None = None, b: str | None = None, size: tuple[int, int] = (12, 9)) -> None:
    register(name, lambda s, d: make(s, *size).select(*KEY, *RGB), f"SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for e, c in zip((r, g or r, b or r), RGB, strict=True))} FROM {_XY.format(w=size[0], h=size[1])}")


_GRAY = lambda v, signed=True: Q(f"round(({f'{v}*0.5 + 0.5' if signed else v})*65535, 6)")
_NX, _NY = "(x/12.0*3)", "(y/9.0*3)"
textured("noise_perlin", lambda s, w, h: noise.texture(s, w, h, lambda x, y: noise.perlin(x, y, 5), 3.0), _GRAY(_sql_perlin(_NX, _NY, 5)))
textured("noise_simplex", lambda s, w, h: noise.texture(s, w, h, lambda x, y: noise.simplex(x, y, 5), 3.0), _GRAY(_sql_simplex(_NX, _NY, 5)))
textured("noise_worley", lambda s, w, h: noise.texture(s, w, h, lambda x, y: noise.worley(x, y, 5), 3.0, False), _GRAY(f"{_sql_worley(_NX, _NY, 5)}[1]", False))
textured("noise_worley_between", lambda s, w, h: noise.texture(s, w, h, lambda x, y: noise.worley(x, y, 5, between=True), 3.0, False), _GRAY(f"({_sql_worley(_NX, _NY, 5)}[2] - {_sql_worley(_NX, _NY, 5)}[1])", False))
textured("noise_fbm", lambda s, w, h: noise.texture(s, w, h, lambda x, y: noise.fbm(x, y, 3, seed=2), 3.0), _GRAY(_sql_fbm(_NX, _NY, 3, 0.5, 2, False)))
textured("noise_turbulence", lambda s, w, h: noise.texture(s, w, h, lambda x, y: noise.fbm(x, y, 3, seed=2, folded=True), 3.0, False), _GRAY(_sql_fbm(_NX, _NY, 3, 0.5, 2, True), False))
textured("marble", lambda s, w, h: noise.marble(s, w, h, 3.0, 4.0, 2, 7), _GRAY(f"sin({_NX} + {_sql_fbm(_NX, _NY, 2, 0.5, 7, True)}*4.0)"))
_WX, _WY = "((x/12.0 - 0.5)*4)", "((y/9.0 - 0.5)*4)"
_RING = f"((sin((sqrt({_WX}*{_WX} + {_WY}*{_WY}) + {_sql_perlin(f'{_WX}*2', f'{_WY}*2', 3)}*0.1)*12*pi()) + 1)*0.5)"
textured("wood", lambda s, w, h: noise.wood(s, w, h, seed=3), *[f"CAST(floor(round({_RING}*{(b - a) * 257}, 6)) + {a * 257} AS INT)" for a, b in ((100, 200), (60, 150), (20, 80))])
textured("plasma", lambda s, w, h: noise.plasma(s, w, h, 1), *[_GRAY(_sql_fbm("(x/12.0*2)", "(y/9.0*2)", 7, 0.6, 1 + 100 * k, False)) for k in range(3)])


def _sql_stops(t: str, stops: list, c: int) -> str:
    out = f"CASE WHEN {t} <= {stops[0][0]} THEN {stops[0][c]}"
    for one, two in zip(stops, stops[1:], strict=False):
        out += f" WHEN {t} <= {two[0]} THEN ({t} - {one[0]})/{two[0] - one[0]!r}*{two[c] - one[c]} + {one[c]}"
    return Q(f"round({out} ELSE {stops[-1][c]} END, 6)")


_STOPS = [(0.0, 0, 1000, 60000), (0.3, 65535, 20000, 0), (0.8, 100, 65535, 30000), (1.0, 40000, 40000, 40000)]
_LT = "least(greatest(((x - 5.5)*cos(radians(30)) + (y - 4)*sin(radians(30)))*0.5/(5.5*cos(radians(30)) + 4*sin(radians(30))) + 0.5, 0), 1)"
_RT = "least(sqrt((x - 3.3)*(x - 3.3) + (y - 4.0)*(y - 4.0))/sqrt(7.7*7.7 + 16), 1)"
textured("gradient_linear_stops", lambda s, w, h: noise.linear_stops(s, w, h, _STOPS, 30.0), *[_sql_stops(_LT, _STOPS, c) for c in (1, 2, 3)])
textured("gradient_radial_stops", lambda s, w, h: noise.radial_stops(s, w, h, _STOPS, 0.3, 0.5), *[_sql_stops(_RT, _STOPS, c) for c in (1, 2, 3)])
for _name, (_n, _rows) in noise.PATTERNS.items():
    textured(f"pattern_{_name}", lambda s, w, h, n=_name: noise.pattern(s, w, h, n, (100, 200, 300), (400, 500, 600)), *[f"CASE WHEN (([{', '.join(map(str, _rows))}])[y % {len(_rows)} + 1] >> ({_n - 1} - x % {_n})) & 1 = 1 THEN {a} ELSE {b} END" for a, b in ((100, 400), (200, 500), (300, 600))])

# --- shapes -------------------------------------------------------------------------------------------------------------------------


def shaped(name: str, shape, coverage: str) -> None:
    register(name, lambda s, d: shape(s, 16, 12).select("y", "x", F.round("coverage", 6).alias("coverage")), f"SELECT * FROM (SELECT y, x, round(least(greatest({coverage}, 0), 1), 6) AS coverage FROM {_XY.format(w=16, h=12)}) WHERE coverage > 0")


def _sql_polygon(points) -> str:
    return "(" + " + ".join(f"CASE WHEN y + 0.5 >= {min(ya, yb)!r} AND y + 0.5 < {max(ya, yb)!r} AND x + 0.5 < (y + 0.5 - {ya!r})*({(xb - xa) / (yb - ya)!r}) + {xa!r} THEN 1 ELSE 0 END" for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]], strict=True) if ya != yb) + ") % 2"


def _sql_stroke(parts, stroke: float) -> str:
    far = []
    for (xa, ya), (xb, yb) in parts:
        dx, dy = xb - xa, yb - ya
        dx, dy, xa, ya = (f"{v!r}::DOUBLE" for v in (dx, dy, xa, ya))
        t = f"least(greatest(((x + 0.5 - {xa})*({dx}) + (y + 0.5 - {ya})*({dy}))/(({dx})*({dx}) + ({dy})*({dy})), 0), 1)"
        far.append(f"pow(x + 0.5 - ({t}*({dx}) + {xa}), 2) + pow(y + 0.5 - ({t}*({dy}) + {ya}), 2)")
    return f"{stroke / 2 + 0.5} - sqrt(least({', '.join(far)}))"


_LINE = [(1.0, 1.5), (8.0, 10.0), (14.5, 2.0)]
_POLYGONS = {"polygon_regular": drawing.regular_polygon(8.2, 6.1, 5.3, 5), "polygon_star": drawing.star(8.2, 6.1, 5.7, 2.3, 5), "polygon_circle": drawing.circle(7.9, 5.7, 4.6, 24), "rectangle_rounded": drawing.rounded_rectangle(2.2, 1.3, 11.1, 8.9, 3.0, 2.0), "path": drawing.parse_path("M 2.1 1.2 L 13.3 2.2 q 2 4 -1 8.1 H 3.1 V 7.2 C 1.1 6.1 5.2 4.3 2.1 1.2 Z")[0]}
for _name, _points in _POLYGONS.items():
    shaped(f"shape_{_name}", lambda s, w, h, p=_points: drawing.polygon(s, w, h, p), _sql_polygon(_points))
shaped("shape_polyline", lambda s, w, h: drawing.polyline(s, w, h, _LINE, 1.6), _sql_stroke(list(zip(_LINE, _LINE[1:], strict=False)), 1.6))
shaped("shape_dashes", lambda s, w, h: drawing.polyline(s, w, h, _LINE, 1.2, (3.0, 2.0)), _sql_stroke(drawing.dashed(_LINE, (3.0, 2.0)), 1.2))
shaped("shape_point", lambda s, w, h: drawing.rectangle(s, w, h, 5, 4, 6, 5), "CASE WHEN x = 5 AND y = 4 THEN 1 ELSE 0 END")
_DISC = "least(greatest((1 - sqrt((x+0.5-4)*(x+0.5-4)/9.0 + (y+0.5-4)*(y+0.5-4)/9.0))*3 + 0.5, 0), 1)"
for _name, _paint, _t in (("linear", lambda df, sh: drawing.paint_linear(df, sh, 1, 1, 7, 5, (0, 60000, 10000), (65535, 0, 30000)), "((x+0.5-1)*6 + (y+0.5-1)*4)/52.0"), ("radial", lambda df, sh: drawing.paint_radial(df, sh, 3, 4, 4, (0, 60000, 10000), (65535, 0, 30000)), "sqrt((x+0.5-3)*(x+0.5-3) + (y+0.5-4)*(y+0.5-4))/4.0")):
    register(f"fill_{_name}_gradient", lambda s, d, f=_paint: f(rasters.rgb(s, d), drawing.ellipse(s, 8, 8, 4, 4, 3, 3)).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, x, {', '.join(f'CAST(floor(round({c}*(1 - {_DISC}) + (least(greatest({_t}, 0), 1)*{b - a} + {a})*{_DISC}, 6) + 0.5) AS INT) AS {c}' for c, a, b in zip(RGB, (0, 60000, 10000), (65535, 0, 30000), strict=True))} FROM px")

# --- neighbourhoods and sizes -------------------------------------------------------------------------------------------------------

_NEAR = "(([" + ", ".join(str(w) for row in filters.NEAR for w in row) + "])[(dy+2)*5+dx+3]/25.0*greatest(0, 1 - abs({n} - {p})/65535.0*3))"
_AROUND = "o AS (SELECT dx, dy FROM (SELECT unnest(range(-{r}, {r}+1)) AS dx) a, (SELECT unnest(range(-{r}, {r}+1)) AS dy) b)"
register("enhance", lambda s, d: filters.enhance(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, {_AROUND.format(r=2)} SELECT p.image_id, p.y, p.x, {', '.join('CAST(floor(round(sum({w}*q.{c})/sum({w}), 6)) AS INT) AS {c}'.format(w=_NEAR.format(n=f'q.{c}', p=f'p.{c}'), c=c) for c in RGB)} FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = least(greatest(p.x+dx, 0), 7) AND q.y = least(greatest(p.y+dy, 0), 7) GROUP BY 1, 2, 3")
_LC = f"l AS (SELECT *, {L601} AS l FROM px), m AS (SELECT p.image_id, p.y, p.x, sum((3 - abs(dx))*(3 - abs(dy))*q.l)/81.0 AS m FROM l p, o JOIN l q ON q.image_id = p.image_id AND q.x = least(greatest(p.x+dx, 0), 7) AND q.y = least(greatest(p.y+dy, 0), 7) GROUP BY 1, 2, 3)"
register("local_contrast", lambda s, d: neighbourhood.local_contrast(rasters.rgb(s, d), 2, 60.0).select(*KEY, *RGB), f"WITH {PX}, {_AROUND.format(r=2)}, {_LC} SELECT l.image_id, l.y, l.x, {', '.join(f'CAST(floor(least(greatest(round({c}*CASE WHEN l > 1 THEN (l + (l - m)*0.6)/l ELSE 1 END, 6), 0), 65535)) AS INT) AS {c}' for c in RGB)} FROM l JOIN m ON m.image_id = l.image_id AND m.y = l.y AND m.x = l.x")
_SH = f"l AS (SELECT *, {L709} AS l FROM px), n AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY image_id, y ORDER BY x), l) - coalesce(lead(l) OVER (PARTITION BY image_id, y ORDER BY x), l) AS nx, coalesce(lag(l) OVER (PARTITION BY image_id, x ORDER BY y), l) - coalesce(lead(l) OVER (PARTITION BY image_id, x ORDER BY y), l) AS ny FROM l), v AS (SELECT *, least(greatest(round(CASE WHEN abs(nx) < 0.5 AND abs(ny) < 0.5 THEN 65535*sin(radians(40)) ELSE (nx*65535*cos(radians(25))*cos(radians(40)) + ny*65535*sin(radians(25))*cos(radians(40)) + 131070.0*65535*sin(radians(40)))/sqrt(nx*nx + ny*ny + 131070.0*131070) END, 6), 0), 65535) AS v FROM n)"
register("shade", lambda s, d: neighbourhood.shade(rasters.rgb(s, d), 25.0, 40.0).select(*KEY, *RGB), f"WITH {PX}, {_SH} SELECT image_id, y, x, CAST(floor(v) AS INT) AS r, CAST(floor(v) AS INT) AS g, CAST(floor(v) AS INT) AS b FROM v")
register("shade_tinted", lambda s, d: neighbourhood.shade(rasters.rgb(s, d), 25.0, 40.0, True).select(*KEY, *RGB), f"WITH {PX}, {_SH} SELECT image_id, y, x, {', '.join(f'CAST(floor(round({c}*v/65535, 6)) AS INT) AS {c}' for c in RGB)} FROM v")
register("lens_blur", lambda s, d: neighbourhood.lens_blur(rasters.rgb(s, d), 2).select(*KEY, *RGB), f"WITH {PX}, {_AROUND.format(r=2)} SELECT p.image_id, p.y, p.x, {', '.join(f'CAST(floor(round(avg(q.{c}), 6) + 0.5) AS INT) AS {c}' for c in RGB)} FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = p.x+dx AND q.y = p.y+dy WHERE dx*dx + dy*dy <= 4 GROUP BY 1, 2, 3")
register("pointillize", lambda s, d: neighbourhood.pointillize(rasters.rgb(s, d), 2, 3, 40000).select(*KEY, *RGB), f"WITH {PX}, k AS (SELECT image_id, y AS cy, x AS cx, r, g, b FROM px WHERE x IN (2, 5) AND y IN (2, 5)), d AS (SELECT px.image_id, px.y, px.x, arg_max(struct_pack(r := k.r, g := k.g, b := k.b), cy*100 + cx) AS d FROM px JOIN k ON k.image_id = px.image_id AND (px.x-cx)*(px.x-cx) + (px.y-cy)*(px.y-cy) <= 4 GROUP BY 1, 2, 3) SELECT px.image_id, px.y, px.x, {', '.join(f'coalesce(d.d.{c}, 40000) AS {c}' for c in RGB)} FROM px LEFT JOIN d ON d.image_id = px.image_id AND d.y = px.y AND d.x = px.x")


def _sized(name: str, f, target: tuple[int, int], method: str = "lanczos3") -> None:
    register(name, lambda s, d: f(rasters.rgb(s, d)).select(*KEY, *RGB), f"WITH {PX}, tx AS (SELECT * FROM {_taps(8, target[0], method)} t), ty AS (SELECT * FROM {_taps(8, target[1], method)} t), h AS (SELECT image_id, y, tx.o AS x, {', '.join(f'sum({c}*w) AS {c}' for c in RGB)} FROM px JOIN tx ON tx.i = x GROUP BY 1,2,3) SELECT image_id, CAST(ty.o AS INT) AS y, CAST(x AS INT) AS x, {', '.join(f'CAST(floor(least(greatest(round(sum({c}*w),6),0),65535)+0.5) AS INT) AS {c}' for c in RGB)} FROM h JOIN ty ON ty.i = y GROUP BY 1, ty.o, 3")


_sized("magnify", lambda d: geometry.magnify(d, (8, 8)), (16, 16))
_sized("minify", lambda d: geometry.minify(d, (8, 8)), (4, 4))
_sized("thumbnail", lambda d: geometry.thumbnail(d, (8, 8), (9, 5), "mitchell"), (5, 5), "mitchell")
_sized("resample", lambda d: geometry.resample(d, (8, 8), (100.0, 50.0), (72.0, 0.0), "catrom"), (11, 6), "catrom")
_KG = [math.exp(-k * k / (2 * 0.6 * 0.6)) for k in range(-2, 3)]
_BLUR = f"o AS (SELECT dx, dy, wx::DOUBLE*wy::DOUBLE AS w FROM (VALUES {', '.join(f'({k - 2}, {w / sum(_KG)!r})' for k, w in enumerate(_KG))}) a(dx, wx), (VALUES {', '.join(f'({k - 2}, {w / sum(_KG)!r})' for k, w in enumerate(_KG))}) b(dy, wy)), s AS (SELECT p.image_id, p.y, p.x, {', '.join(f'CAST(floor(least(greatest(round(sum(q.{c}*w), 6), 0), 65535) + 0.5) AS INT) AS s{c}' for c in RGB)} FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = least(greatest(p.x+dx, 0), 7) AND q.y = least(greatest(p.y+dy, 0), 7) GROUP BY 1, 2, 3), both_ AS (SELECT px.*, sr, sg, sb FROM px JOIN s ON s.image_id = px.image_id AND s.y = px.y AND s.x = px.x)"
register("sharpen", lambda s, d: neighbourhood.sharpen(rasters.rgb(s, d), 0.6, 1.3).select(*KEY, *RGB), f"WITH {PX}, {_BLUR} SELECT image_id, y, x, {', '.join(f'CAST(floor(least(greatest(round({c} + ({c} - s{c})*1.3, 6), 0), 65535) + 0.5) AS INT) AS {c}' for c in RGB)} FROM both_")
register("unsharp_mask", lambda s, d: neighbourhood.unsharp_mask(rasters.rgb(s, d), 0.6, 1.0, 0.02).select(*KEY, *RGB), f"WITH {PX}, {_BLUR} SELECT image_id, y, x, {', '.join(f'CAST(CASE WHEN abs(({c} - s{c})*2) < 0.02*65535 THEN {c} ELSE floor(least(greatest({c} + ({c} - s{c}), 0), 65535)) END AS INT) AS {c}' for c in RGB)} FROM both_")
register("frequency_high", lambda s, d: neighbourhood.frequency_separation(rasters.rgb(s, d), 0.6)[1].select(*KEY, *RGB), f"WITH {PX}, {_BLUR} SELECT image_id, y, x, {', '.join(f'CAST(least(greatest({c} - s{c} + 32767, 0), 65535) AS INT) AS {c}' for c in RGB)} FROM both_")
register("feather_mask", lambda s, d: neighbourhood.gaussian_blur(rasters.rgb(s, d), 0.6).select(*KEY, *RGB), f"WITH {PX}, {_BLUR} SELECT image_id, y, x, sr AS r, sg AS g, sb AS b FROM both_")
for _name, _f, _agg in (("expand_mask", neighbourhood.dilate, "max"), ("contract_mask", neighbourhood.erode, "min")):
    register(_name, lambda s, d, f=_f: f(rasters.rgb(s, d), [(x, y) for y in range(-2, 3) for x in range(-2, 3) if x * x + y * y <= 4]).select(*KEY, *RGB), f"WITH {PX}, {_AROUND.format(r=2)} SELECT p.image_id, p.y, p.x, {', '.join(f'{_agg}(q.{c}) AS {c}' for c in RGB)} FROM px p, o JOIN px q ON q.image_id = p.image_id AND q.x = least(greatest(p.x+dx, 0), 7) AND q.y = least(greatest(p.y+dy, 0), 7) WHERE dx*dx + dy*dy <= 4 GROUP BY 1, 2, 3")

# --- functions without a query so far -----------------------------------------------------------------------------------------------

_PF = [f"({c}*0.75::DOUBLE + {c}*({k}/65535.0)*0.25::DOUBLE)" for c, k in zip(RGB, (60000, 40000, 10000), strict=True)]
_PFL = f"({_PF[0]}*0.2126 + {_PF[1]}*0.7152 + {_PF[2]}*0.0722)"
pixels("photo_filter", lambda d: point.photo_filter(d, 60000, 40000, 10000, 0.25), *[T(f"{v} * CASE WHEN {_PFL} > 0 THEN {L709}/{_PFL} ELSE 1 END") for v in _PF])
_K = "(least(1-r/65535.0, 1-g/65535.0, 1-b/65535.0)*0.9)"
_INK = f"((1-r/65535.0) + (1-g/65535.0) + (1-b/65535.0) - 3*{_K} + {_K})"
pixels("soft_proof", lambda d: point.soft_proof(d, 1.2, 0.9), Q(f"least(greatest(1 - (1-{{v}}/65535.0)*CASE WHEN {_INK} > 1.2 THEN 1.2/{_INK} ELSE 1 END, 0), 1)*65535"))
pixels("curves", lambda d: point.curves(d, [(0.0, 0.0), (1.0, 0.5)]), Q("{v}/65535.0*0.5*65535"))
_STAT = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in RGB)
register("color_transfer", lambda s, d: histogram.color_transfer(rasters.rgb(s, d), rasters.rgb(s, d).where("image_id = 0"), 0.7).select(*KEY, *RGB), f"WITH {PX}, a AS (SELECT image_id, {_STAT} FROM px GROUP BY 1), q AS (SELECT {_STAT.replace(' AS m', ' AS qm').replace(' AS s', ' AS qs')} FROM px WHERE image_id = 0) SELECT px.image_id, y, x, {', '.join(T(f'round({c} + (({c} - m{c})/CASE WHEN s{c} > 0 THEN s{c} ELSE 1 END*qs{c} + qm{c} - {c})*0.7, 6)') + f' AS {c}' for c in RGB)} FROM px JOIN a ON a.image_id = px.image_id, q")
register("spatial_tiles", lambda s, d: rasters.mosaic(s, d).groupBy(F.floor(F.col("y") / 16).cast("int").alias("ty"), F.floor(F.col("x") / 32).cast("int").alias("tx")).agg(F.count("*").alias("n"), F.sum("r").alias("total"), F.max("r").alias("most")), f"WITH {EMB} SELECT CAST(((image_id//20)*8+y)//16 AS INT) AS ty, CAST(((image_id%20)*8+x)//32 AS INT) AS tx, count(*) AS n, sum(v) AS total, max(v) AS most FROM emb GROUP BY 1, 2")

# --- whole images as rows -----------------------------------------------------------------------------------------------------------


def framed(name: str, f, sql: str) -> None:
    register(name, lambda s, d: codecs.to_pixels(f(frames.from_pixels(rasters.rgb(s, d)))).select(*KEY, *RGB), sql)


framed("frames_identity", lambda i: i, f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px")
framed("frames_normalize", frames.normalize, ORACLES["normalize"])
framed("frames_sample", lambda i: frames.sample(i, 12, 5), ORACLES["sample"])
_CFA = "m AS (SELECT image_id, y, x, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN r WHEN y % 2 = 1 AND x % 2 = 1 THEN b ELSE g END AS v FROM px)"
_MIRROR8 = lambda e: f"CASE WHEN {e} < 0 THEN -({e}) WHEN {e} > 7 THEN 14 - ({e}) ELSE {e} END"
_SAW = "CASE WHEN ({y}) % 2 = 0 AND ({x}) % 2 = 0 THEN 'r' WHEN ({y}) % 2 = 1 AND ({x}) % 2 = 1 THEN 'b' ELSE 'g' END"
framed("demosaic", lambda i: frames.demosaic(frames.mosaic(i)), f"WITH {PX}, {_CFA}, o AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b), n AS (SELECT p.image_id, p.y, p.x, q.v, {_SAW.format(y='p.y', x='p.x')} AS own, {_SAW.format(y='p.y+dy+2', x='p.x+dx+2')} AS saw, dx, dy FROM m p, o JOIN m q ON q.image_id = p.image_id AND q.x = {_MIRROR8('p.x+dx')} AND q.y = {_MIRROR8('p.y+dy')}) SELECT image_id, y, x, {', '.join(f'''CAST(floor(avg(v) FILTER (saw = '{c}' AND CASE WHEN own = '{c}' THEN dx = 0 AND dy = 0 ELSE TRUE END) + 0.5) AS INT) AS {c}''' for c in RGB)} FROM n GROUP BY 1, 2, 3")


# --- what is drawn or made by a formula, laid over every image ----------------------------------------------------------------------


def _over_images(name: str) -> None:
    """A canvas of fixed size over each image of the table, which repeats beneath it: colours mixed evenly, coverage as white paint."""
    query, sql = QUERIES[name], ORACLES.get(name)
    shape = name.startswith(("draw_", "shape_"))

    def run(spark, sf_dir: str) -> DataFrame:
        canvas = query(spark, sf_dir)
        top = canvas.select("y", "x", *([F.col("coverage")] if shape else [F.col(c).alias(f"o{c}") for c in RGB]), F.pmod("y", F.lit(8)).alias("ty"), F.pmod("x", F.lit(8)).alias("tx"))
        px = rasters.rgb(spark, sf_dir).select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), *RGB)
        # the canvas has a fixed size, whatever the table holds
        rows = px.join(F.broadcast(top), ["ty", "tx"])
        new = {c: F.floor(F.col(c) + (F.lit(65535) - F.col(c)) * F.col("coverage") + 0.5) if shape else F.floor((F.col(c) + F.col(f"o{c}")) / 2) for c in RGB}
        return rows.select(*KEY, *[v.cast("int").alias(c) for c, v in new.items()])

    mixed = ", ".join(f"CAST(floor(px.{c} + (65535 - px.{c})*cv.coverage + 0.5) AS INT) AS {c}" if shape else f"(px.{c} + cv.{c}) // 2 AS {c}" for c in RGB)
    register(name, run, sql and f"WITH {PX}, cv AS ({sql}) SELECT px.image_id, CAST(cv.y AS INT) AS y, CAST(cv.x AS INT) AS x, {mixed} FROM cv JOIN px ON px.y = ((cv.y % 8) + 8) % 8 AND px.x = ((cv.x % 8) + 8) % 8")


for _name in [n for n in QUERIES if n in ("gradient", "checkerboard", "stripes", "solid", "linear_gradient", "radial_gradient", "value_noise", "marble", "wood", "plasma", "gradient_linear_stops", "gradient_radial_stops", "draw_polygon", "draw_ellipse", "draw_line") or n.startswith(("noise_", "pattern_", "shape_"))]:
    _over_images(_name)
