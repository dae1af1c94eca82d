"""SQL for queries that had none, written from what the operators are said to do."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .catalog import KEY, L709, LONG, ORACLES, PX, RGB, _PACK, register
from .catalog_more import warped
from .operators import frames, geometry
from .sources import codecs, rasters


def _each(template: str) -> str:
    return ", ".join(f"{template.replace('{c}', c)} AS {c}" for c in RGB)


# --- tone maps and thresholds -------------------------------------------------------------------------------------------------------

_T6 = "CAST(floor(round(least(greatest({v}, 0), 65535), 6)) AS INT)"
_L = f"l AS (SELECT *, {L709}/65535.0::DOUBLE AS l FROM px)"
_REINHARD = "(l*(0.18::DOUBLE/exp(m)))/(l*(0.18::DOUBLE/exp(m)) + 1)"
ORACLES["tone_map_reinhard"] = f"WITH {PX}, {_L}, m AS (SELECT image_id, avg(ln(l + 1e-6::DOUBLE)) AS m FROM l GROUP BY 1) SELECT image_id, y, x, {_each(_T6.format(v='{c}/65535.0::DOUBLE*CASE WHEN l > 1e-6 THEN ' + _REINHARD + '/l ELSE 0 END*65535'))} FROM l JOIN m USING (image_id)"
_DRAGO = f"least(greatest(log10(l + 1)/(log10(t + 1)*log10(pow(l/(t + 1e-6::DOUBLE), {math.log(0.85) / math.log(0.5)!r}::DOUBLE)*8 + 2)), 0), 1)"
ORACLES["tone_map_drago"] = f"WITH {PX}, {_L}, m AS (SELECT image_id, max(l) AS t FROM l GROUP BY 1) SELECT image_id, y, x, {_each(_T6.format(v='{c}/65535.0::DOUBLE*CASE WHEN l > 1e-6 THEN ' + _DRAGO + '/l ELSE 0 END*65535'))} FROM l JOIN m USING (image_id)"

# grayscale, normalised, thresholded by the first bin of greatest between-class variance
ORACLES["flagship"] = (
    f"WITH {PX}, g AS (SELECT image_id, CAST(floor({L709} + 0.5) AS INT) AS g FROM px), e AS (SELECT image_id, min(g) AS lo, max(g) AS hi FROM g GROUP BY 1), "
    "n AS (SELECT image_id, CASE WHEN hi > lo THEN CAST(floor((g - lo)/CAST(hi - lo AS DOUBLE)*65535 + 0.5) AS INT) ELSE g END AS r FROM g JOIN e USING (image_id)), l AS (SELECT image_id, (r::DOUBLE*0.2126 + r::DOUBLE*0.7152 + r::DOUBLE*0.0722)/65535.0 AS l FROM n), "
    "h AS (SELECT image_id, CAST(floor(l*255 + 0.5) AS INT) AS bin, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER w AS cum, sum(bin*n) OVER w AS s, sum(n) OVER (PARTITION BY image_id) AS total, sum(bin*n) OVER (PARTITION BY image_id) AS al FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin)), "
    "o AS (SELECT image_id, bin, CAST(cum AS DOUBLE)*(total-cum)*(s/CAST(cum AS DOUBLE)-(al-s)/CAST(total-cum AS DOUBLE))*(s/CAST(cum AS DOUBLE)-(al-s)/CAST(total-cum AS DOUBLE)) AS bt FROM k WHERE cum < total), "
    "b AS (SELECT image_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY bt DESC, bin) AS rn FROM o) WHERE rn = 1) SELECT l.image_id, count(*) AS n, count(*) FILTER (WHERE l >= coalesce(bin, 0)/255.0::DOUBLE) AS foreground FROM l LEFT JOIN b USING (image_id) GROUP BY 1"
)

# --- warps --------------------------------------------------------------------------------------------------------------------------

warped("affine", lambda s, d: geometry.affine(rasters.rgb(s, d), (8, 8), (1.0, 0.0, 0.0, 1.0, 1.5, -0.5)), "px - 1.5", "py + 0.5", centred=True)
_T2 = "pow(greatest(0, 1 - sqrt((px-4)*(px-4) + (py-4)*(py-4))/4), 2)*radians(60)"
warped("swirl", lambda s, d: geometry.swirl(rasters.rgb(s, d), (8, 8), 60.0), f"cos({_T2})*(px-4) - sin({_T2})*(py-4) + 4", f"sin({_T2})*(px-4) + cos({_T2})*(py-4) + 4", "sx >= 0 AND sx < 7 AND sy >= 0 AND sy < 7")
_F = "(0.1::DOUBLE*sqrt((px-4)*(px-4) + (py-4)*(py-4))/4 + 0.9)"
warped("barrel", lambda s, d: geometry.barrel(rasters.rgb(s, d), (8, 8), 0.0, 0.0, 0.1, 0.9), f"(px-4)*{_F} + 4", f"(py-4)*{_F} + 4", centred=True)

# --- neighbourhoods -----------------------------------------------------------------------------------------------------------------


def _around(radius: int, of: str = "lg", more: str = "") -> str:
    """Every place with each of its neighbours (edges repeated): n(image_id, y, x, c, v, dx, dy, q)."""
    side = f"SELECT unnest(range(-{radius}, {radius + 1})) AS "
    return f"n AS (SELECT p.image_id, p.y, p.x, p.c, p.v, dx, dy, q.v AS q{more} FROM {of} p, ({side}dx) a, ({side}dy) b JOIN {of} q ON q.image_id = p.image_id AND q.c = p.c AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7))"


def _wide(value: str, source: str) -> str:
    """Channels of (image_id, y, x, c, v) side by side."""
    return f"SELECT image_id, y, x, {', '.join(f'max(CASE WHEN c = {k} THEN {value} END) AS {n}' for k, n in enumerate(RGB))} FROM {source} GROUP BY 1, 2, 3"


_POSTER = LONG.replace("lg AS (", "lg0 AS (") + ", lg AS (SELECT image_id, y, x, c, CAST(floor(least(greatest(round_even(v/65535.0/0.125, 0)*0.125*65535, 0), 65535) + 0.5) AS INT) AS v FROM lg0)"
ORACLES["statistic_mode"] = f"WITH {_POSTER}, {_around(1)}, k AS (SELECT image_id, y, x, c, q, count(*) AS n FROM n GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x, c ORDER BY n DESC, q) AS k FROM k), r AS (SELECT * FROM o WHERE k = 1) {_wide('q', 'r')}"
ORACLES["statistic_nonpeak"] = f"WITH {LONG}, {_around(1)}, e AS (SELECT *, min(q) OVER w AS lo, max(q) OVER w AS hi FROM n WINDOW w AS (PARTITION BY image_id, y, x, c)), r AS (SELECT image_id, y, x, c, CAST(coalesce(sum(q) FILTER (WHERE q <> lo AND q <> hi) // count(*) FILTER (WHERE q <> lo AND q <> hi), (min(lo) + max(hi)) // 2) AS INT) AS s FROM e GROUP BY 1, 2, 3, 4) {_wide('s', 'r')}"
_GX, _GY = "dx*(2 - abs(dy))", "dy*(2 - abs(dx))"
_SLOPES = f"{{lum}}, {_around(1, 'lu')}, g AS (SELECT image_id, y, x, sum(q*{_GX})::DOUBLE AS gx, sum(q*{_GY})::DOUBLE AS gy FROM n GROUP BY 1, 2, 3)"
ORACLES["sobel"] = f"WITH {PX}, {_SLOPES.format(lum=f'lu AS (SELECT image_id, y, x, 0 AS c, CAST(floor({L709} + 0.5) AS INT) AS v FROM px)')} SELECT image_id, y, x, round(sqrt(gx*gx + gy*gy), 6) AS magnitude FROM g"
_LEN = "sqrt(gx/65535*(gx/65535) + gy/65535*(gy/65535) + 1)"
_R3 = "(r::DOUBLE*0.2126 + r::DOUBLE*0.7152 + r::DOUBLE*0.0722)"
ORACLES["normal_map"] = f"WITH {PX}, {_SLOPES.format(lum=f'lu AS (SELECT image_id, y, x, 0 AS c, CAST(floor({_R3} + 0.5) AS INT) AS v FROM px)')} SELECT image_id, y, x, CAST(floor((-gx/65535/{_LEN} + 1)/2*65535 + 0.5) AS INT) AS r, CAST(floor((-gy/65535/{_LEN} + 1)/2*65535 + 0.5) AS INT) AS g, CAST(floor((1/{_LEN} + 1)/2*65535 + 0.5) AS INT) AS b FROM g"
_ALIKE = f"{LONG}, {_around(3)}, d AS (SELECT *, max(abs(q - v)) OVER (PARTITION BY image_id, y, x, dx, dy) AS far FROM n)"
_W = "exp(-(dx*dx + dy*dy)/(2*0.7::DOUBLE*0.7))"
ORACLES["selective_blur"] = f"WITH {_ALIKE}, r AS (SELECT image_id, y, x, c, CAST(floor(sum(q*{_W})/sum({_W}) + 0.5) AS INT) AS s FROM d WHERE far <= 0.1::DOUBLE*65535 GROUP BY 1, 2, 3, 4) {_wide('s', 'r')}"
# four quadrants of two by two, in the order of the corners; the least spread of luma takes its means
_QUAD = "(SELECT 0 AS k, -1 AS sx, -1 AS sy UNION ALL SELECT 1, 1, -1 UNION ALL SELECT 2, -1, 1 UNION ALL SELECT 3, 1, 1)"
ORACLES["kuwahara"] = (
    f"WITH {PX}, l AS (SELECT *, {L709} AS l FROM px), q AS (SELECT p.image_id, p.y, p.x, k, avg(q.l) AS m, {', '.join(f'sum(q.{c}::DOUBLE)/4 AS {c}' for c in RGB)}, var_pop(q.l) AS spread FROM l p, {_QUAD} o, (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1]) AS j) j JOIN l q ON q.image_id = p.image_id AND q.x = least(greatest(p.x + sx*i, 0), 7) AND q.y = least(greatest(p.y + sy*j, 0), 7) GROUP BY 1, 2, 3, 4), "
    f"o AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY round(spread, 3), k) AS n FROM q) SELECT image_id, y, x, {_each('CAST(floor({c}) AS INT)')} FROM o WHERE n = 1"
)

# --- places along a line or an arc --------------------------------------------------------------------------------------------------


def _places(rows: str, x: str, y: str) -> str:
    """Weighted means of the nearest pixels at real places; what lies outside doesn't count."""
    at = f"SELECT p.image_id, p.y, p.x, w, CAST(round_even({x}, 0) AS INT) AS sx, CAST(round_even({y}, 0) AS INT) AS sy FROM px p, ({rows}) o"
    return f"WITH {PX}, a AS ({at}) SELECT a.image_id, a.y, a.x, {_each('CAST(floor(round(sum(q.{c}*w)/sum(w), 9) + 0.5) AS INT)')} FROM a JOIN px q ON q.image_id = a.image_id AND q.y = sy AND q.x = sx GROUP BY 1, 2, 3"


ORACLES["motion_blur"] = _places("SELECT n, exp(-n*n/2.0::DOUBLE) AS w FROM (SELECT unnest(range(-2, 3)) AS n)", "p.x + n*cos(radians(30))", "p.y + n*sin(radians(30))")
_STEPS = max(3, int(40 * math.sqrt(math.hypot(4, 4))) + 1) | 1
ORACLES["radial_blur"] = _places(f"SELECT (n - {_STEPS // 2})*(radians(20)/{_STEPS - 1}) AS t, 1.0::DOUBLE AS w FROM (SELECT unnest(range({_STEPS})) AS n)", "(p.x-4)*cos(t) - (p.y-4)*sin(t) + 4", "(p.x-4)*sin(t) + (p.y-4)*cos(t) + 4")

# --- light --------------------------------------------------------------------------------------------------------------------------


def _blur(sigma: float, source: str, name: str) -> str:
    """Gaussian of (image_id, y, x, c, v) along y, then along x, edges repeated."""
    r = max(1, math.ceil(3 * sigma))
    k = f"k AS (SELECT d, exp(-d*d/(2*{sigma}::DOUBLE*{sigma}))/sum(exp(-d*d/(2*{sigma}::DOUBLE*{sigma}))) OVER () AS w FROM (SELECT unnest(range(-{r}, {r + 1})) AS d))"
    step = lambda of, a, b: f"SELECT p.image_id, p.y, p.x, p.c, sum(q.v*w) AS v FROM {of} p, k JOIN {of} q ON q.image_id = p.image_id AND q.c = p.c AND q.{a} = least(greatest(p.{a} + d, 0), 7) AND q.{b} = p.{b} GROUP BY 1, 2, 3, 4"
    return f"{k}, t1 AS MATERIALIZED ({step(source, 'y', 'x')}), {name} AS ({step('t1', 'x', 'y')})"


ORACLES["vignette"] = f"WITH {PX}, e AS (SELECT 0 AS image_id, y, x, 0 AS c, CASE WHEN (x-4)*(x-4)/16.0 + (y-4)*(y-4)/16.0 <= 1 THEN 65535.0::DOUBLE ELSE 0 END AS v FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)), {_blur(10.0, 'e', 'm')} SELECT px.image_id, px.y, px.x, {_each('CAST(floor({c}*(floor(round(v, 6) + 0.5)/65535) + 0.5) AS INT)')} FROM px JOIN m ON m.y = px.y AND m.x = px.x"
ORACLES["glow"] = f"WITH {LONG}, li AS (SELECT image_id, y, x, (77*r + 150*g + 29*b) >> 8 AS li FROM px), s AS (SELECT lg.image_id, lg.y, lg.x, c, CASE WHEN li >= 0.5*65535 THEN v::DOUBLE ELSE 0 END AS v FROM lg JOIN li USING (image_id, y, x)), {_blur(2.0, 's', 'm')}, r AS (SELECT lg.image_id, lg.y, lg.x, lg.c, CAST(floor(round(65535 - (65535 - lg.v)*(65535 - least(m.v*0.6::DOUBLE, 65535))/65535, 6) + 0.5) AS INT) AS s FROM lg JOIN m USING (image_id, y, x, c)) {_wide('s', 'r')}"
_LEAST = lambda of, v: f"SELECT p.image_id, p.y, p.x, min(q.{v}) AS d FROM {of} p JOIN {of} q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3"
ORACLES["dehaze"] = (
    f"WITH {PX}, a AS (SELECT *, least(r, g, b) AS m FROM px), d AS ({_LEAST('a', 'm')}), o AS (SELECT d.*, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, y, x) AS k FROM d), i AS (SELECT px.image_id, {', '.join(f'greatest(px.{c}, 1)::DOUBLE AS a{c}' for c in RGB)} FROM px JOIN o USING (image_id, y, x) WHERE k = 1), "
    f"n AS (SELECT px.*, ar, ag, ab, least(r/ar, g/ag, b/ab) AS nr FROM px JOIN i USING (image_id)), t AS ({_LEAST('n', 'nr')}) SELECT n.image_id, n.y, n.x, {_each('CAST(floor(least(greatest(({c} - a{c})/greatest(1 - 0.5::DOUBLE*d, 0.1::DOUBLE) + a{c}, 0), 65535)) AS INT)')} FROM n JOIN t USING (image_id, y, x)"
)

# --- bent images --------------------------------------------------------------------------------------------------------------------


def _bilinear(places: str, outside: str, joined: str = "") -> str:
    """Four taps at (sx, sy) of s(image_id, y, x, sx, sy, ok), edges repeated; ``outside`` where not ok."""
    tap = lambda dy, dx: f"max(CASE WHEN q.y = least(y0 + {dy}, 7) AND q.x = least(x0 + {dx}, 7) THEN q.{{c}} END)"
    value = f"({tap(0, 0)}*(1 - max(fx)) + {tap(0, 1)}*max(fx))*(1 - max(fy)) + ({tap(1, 0)}*(1 - max(fx)) + {tap(1, 1)}*max(fx))*max(fy)"
    return f"WITH {PX}, s AS ({places}), t AS (SELECT image_id, y, x, ok, CAST(floor(sy) AS INT) AS y0, sy - floor(sy) AS fy, CAST(floor(sx) AS INT) AS x0, sx - floor(sx) AS fx FROM s), b AS (SELECT t.image_id, t.y, t.x, {_each('CAST(floor(round(' + value + ', 6) + 0.5) AS INT)')} FROM t JOIN px q ON q.image_id = t.image_id AND q.y IN (y0, least(y0 + 1, 7)) AND q.x IN (x0, least(x0 + 1, 7)) WHERE ok GROUP BY 1, 2, 3) SELECT t.image_id, t.y, t.x, {outside} FROM t LEFT JOIN b USING (image_id, y, x){joined}"


ORACLES["wave"] = _bilinear("SELECT image_id, CAST(yy AS INT) AS y, x, x::DOUBLE AS sx, CASE WHEN pl >= 0 AND pl < 7 THEN pl ELSE 0 END AS sy, pl >= 0 AND pl < 7 AS ok FROM (SELECT *, yy - (1 + sin(2*pi()*x/6)) AS pl FROM (SELECT DISTINCT image_id, x FROM px), (SELECT unnest(range(10)) AS yy))", _each("coalesce(b.{c}, 0)"))
_NEAR = "pow(sin(pi()/2*d/4), -0.5)"
ORACLES["implode"] = _bilinear(f"SELECT image_id, y, x, least(greatest(CASE WHEN d < 4 AND d > 0 THEN {_NEAR}*(x-4) + 4 WHEN d = 0 THEN 4 ELSE 0 END, 0), 7) AS sx, least(greatest(CASE WHEN d < 4 AND d > 0 THEN {_NEAR}*(y-4) + 4 WHEN d = 0 THEN 4 ELSE 0 END, 0), 7) AS sy, d < 4 AS ok FROM (SELECT *, sqrt(((x-4)*(x-4) + (y-4)*(y-4))::DOUBLE) AS d FROM px)", _each("coalesce(b.{c}, px.{c})"), " JOIN px USING (image_id, y, x)")

# --- hashes -------------------------------------------------------------------------------------------------------------------------

ORACLES["difference_hash"] = f"WITH {PX}, s AS (SELECT image_id, y AS sy, sx, {L709} AS l FROM px JOIN (SELECT unnest(range(9)) AS sx) ON x = sx*8//9), t AS (SELECT image_id, sy*8 + sx AS k, l > lead(l) OVER (PARTITION BY image_id, sy ORDER BY sx) AS bit, sx FROM s) SELECT image_id, {_PACK} FROM t WHERE sx < 8 GROUP BY 1"
_HAAR = lambda of, axis, other: f"SELECT image_id, {other}, {axis}//2 + 4*h AS {axis}, sum(CASE WHEN h = 1 AND {axis} % 2 = 1 THEN -l ELSE l END)*sqrt(0.5::DOUBLE) AS l FROM {of}, (SELECT unnest([0, 1]) AS h) GROUP BY 1, 2, 3"
ORACLES["wavelet_hash"] = f"WITH {PX}, s AS (SELECT image_id, y, x, {L709} AS l FROM px), a AS ({_HAAR('s', 'x', 'y')}), b AS ({_HAAR('a', 'y', 'x')}), c AS (SELECT image_id, y*8 + x AS k, round(l, 6) AS l FROM b), m AS (SELECT image_id, list_sort(list(l))[33] AS m FROM c GROUP BY 1), t AS (SELECT image_id, k, l >= m AS bit FROM c JOIN m USING (image_id)) SELECT image_id, {_PACK} FROM t GROUP BY 1"
_COS = "SELECT k, x, sum(cos((2*i + 1)*k*pi()/64)) AS w FROM (SELECT unnest(range(8)) AS k), (SELECT unnest(range(32)) AS i), (SELECT unnest(range(8)) AS x) WHERE i//4 = x GROUP BY 1, 2"
ORACLES["perceptual_hash"] = f"WITH {PX}, w AS ({_COS}), d AS (SELECT image_id, v.k AS v, u.k AS u, round(sum({L709}*u.w*v.w), 3) AS d FROM px JOIN w u ON u.x = px.x JOIN w v ON v.x = px.y WHERE u.k > 0 OR v.k > 0 GROUP BY 1, 2, 3), m AS (SELECT image_id, list_sort(list(d))[32] AS m FROM d GROUP BY 1), t AS (SELECT image_id, v*8 + u - 1 AS k, d >= m AS bit FROM d JOIN m USING (image_id)) SELECT image_id, {_PACK} FROM t GROUP BY 1"

# --- more of them -------------------------------------------------------------------------------------------------------------------

_K = "exp(-(dx*dx + dy*dy)/(2*1.5::DOUBLE*1.5))*exp(-(floor(abs(q - v)/257.0)/255)*(floor(abs(q - v)/257.0)/255)/(2*0.1::DOUBLE*0.1))"
ORACLES["bilateral"] = f"WITH {LONG}, {_around(2)}, r AS (SELECT image_id, y, x, c, CAST(floor(round(sum(q*({_K}))/sum({_K}), 6)) AS INT) AS s FROM n GROUP BY 1, 2, 3, 4) {_wide('s', 'r')}"
ORACLES["oil_paint"] = (
    f"WITH {PX}, l AS (SELECT *, least(greatest(CAST(floor({L709}/65535.0*255 + 0.5) AS INT), 0), 255) AS bin FROM px), n AS (SELECT p.image_id, p.y, p.x, q.r, q.g, q.b, (q.y-p.y)*3 + q.x-p.x AS s, row_number() OVER (PARTITION BY p.image_id, p.y, p.x, q.bin ORDER BY q.y, q.x) AS k FROM l p JOIN l q ON q.image_id = p.image_id AND abs(q.y-p.y) <= 1 AND abs(q.x-p.x) <= 1), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY k DESC, s) AS f FROM n) SELECT image_id, y, x, r, g, b FROM o WHERE f = 1"
)
_BOX = "abs(q.y-p.y) <= {k} AND abs(q.x-p.x) <= {k}"
ORACLES["harris"] = (
    f"WITH {PX}, {_SLOPES.format(lum=f'lu AS (SELECT image_id, y, x, 0 AS c, CAST(floor({L709} + 0.5) AS INT) AS v FROM px)')}, u AS (SELECT image_id, y, x, gx/65535*(gx/65535) AS xx, gx/65535*(gy/65535) AS xy, gy/65535*(gy/65535) AS yy FROM g), "
    f"s AS (SELECT p.image_id, p.y, p.x, sum(q.xx) AS a, sum(q.xy) AS b, sum(q.yy) AS c FROM u p JOIN u q ON q.image_id = p.image_id AND {_BOX.format(k=1)} GROUP BY 1, 2, 3), r AS (SELECT image_id, y, x, round(a*c - b*b - (a+c)*(a+c)*0.04::DOUBLE, 9) AS response FROM s), "
    f"m AS (SELECT p.image_id, p.y, p.x, p.response, max(q.response) FILTER (WHERE q.y <> p.y OR q.x <> p.x) AS near FROM r p JOIN r q ON q.image_id = p.image_id AND {_BOX.format(k=3)} GROUP BY 1, 2, 3, 4), t AS (SELECT image_id, max(response)*0.01::DOUBLE AS least FROM r GROUP BY 1) SELECT image_id, y, x, response FROM m JOIN t USING (image_id) WHERE response > near AND response > least"
)
# the identity table is linear, so interpolation gives every colour back
ORACLES["apply_hald"] = f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px"
# an opaque overlay covers whatever its pattern is
ORACLES["blend_dissolve"] = f"WITH {PX}, nx AS (SELECT image_id - 1 AS image_id, y, x, r AS r2, g AS g2, b AS b2 FROM px) SELECT image_id, y, x, {_each('coalesce({c}2, {c})')} FROM px LEFT JOIN nx USING (image_id, y, x)"

_HUE = "CASE WHEN hi <= lo THEN 0.0 WHEN hi = r THEN ((g-b)/(hi-lo))/6 WHEN hi = g THEN ((b-r)/(hi-lo) + 2)/6 ELSE ((r-g)/(hi-lo) + 4)/6 END"
_SECTOR = [("c", "x", "0", "0", "x", "c"), ("x", "c", "c", "x", "0", "0"), ("0", "0", "x", "c", "c", "x")]
ORACLES["modulate"] = (
    f"WITH {PX}, u AS (SELECT image_id, y AS py, x AS px_, r/65535.0::DOUBLE AS r, g/65535.0::DOUBLE AS g, b/65535.0::DOUBLE AS b FROM px), v AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM u), "
    f"h AS (SELECT *, {_HUE} AS hu, CASE WHEN hi > lo THEN (hi-lo)/CASE WHEN (hi+lo)/2 <= 0.5 THEN hi+lo ELSE 2-hi-lo END ELSE 0 END AS sa, (hi+lo)/2 AS li FROM v), m AS (SELECT image_id, py, px_, (CASE WHEN hu < 0 THEN hu + 1 ELSE hu END)*6 AS k, least(greatest(sa*1.2::DOUBLE, 0), 1) AS s, least(greatest(li*1.1::DOUBLE, 0), 1) AS l FROM h), "
    f"c AS (SELECT *, (1 - abs(l*2 - 1))*s AS c FROM m), d AS (SELECT *, c*(1 - abs(k % 2 - 1)) AS x FROM c) SELECT image_id, py AS y, px_ AS x, {', '.join('CAST(floor(round(least(greatest((' + 'CASE ' + ' '.join(f'WHEN k < {j + 1} THEN {v}' for j, v in enumerate(row[:5])) + f' ELSE {row[5]} END) + l - c/2, 0), 1)*65535, 6) + 0.5) AS INT) AS {n}' for n, row in zip(RGB, _SECTOR, strict=True))} FROM d"
)
# 8 x 8 is a power of two already; the quadrants are exchanged
ORACLES["spectrum"] = (
    f"WITH {PX}, w AS (SELECT image_id, v.k AS v, u.k AS u, sum({L709}/65535*cos(2*pi()*(u.k*x + v.k*y)/8)) AS re, sum({L709}/65535*sin(2*pi()*(u.k*x + v.k*y)/8)) AS im FROM px, (SELECT unnest(range(8)) AS k) v, (SELECT unnest(range(8)) AS k) u GROUP BY 1, 2, 3), m AS (SELECT image_id, (v + 4) % 8 AS y, (u + 4) % 8 AS x, sqrt(re*re + im*im) AS m FROM w), "
    "s AS (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(floor(round(ln(1 + m)/ln(1 + greatest(max(m) OVER (PARTITION BY image_id), 1e-12))*65535, 6) + 0.5) AS INT) AS v FROM m) SELECT image_id, y, x, v AS r, v AS g, v AS b FROM s"
)

# --- regions ------------------------------------------------------------------------------------------------------------------------

_LIGHT = f"l AS (SELECT *, y*8 + x AS i, {L709}/65535.0::DOUBLE AS l FROM px)"
# the places that each place of the mask reaches; a component is known by the first of them
ORACLES["components"] = (
    f"WITH RECURSIVE {PX}, {_LIGHT}, m AS (SELECT * FROM l WHERE l >= 0.5), e AS (SELECT p.image_id, p.i AS a, q.i AS b FROM m p JOIN m q ON q.image_id = p.image_id AND abs(q.y-p.y) <= 1 AND abs(q.x-p.x) <= 1), "
    "t AS (SELECT image_id, a, b FROM e UNION SELECT t.image_id, t.a, e.b FROM t JOIN e ON e.image_id = t.image_id AND e.a = t.b), f AS (SELECT image_id, a AS i, min(b) AS root FROM t GROUP BY 1, 2), n AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM f) "
    "SELECT m.image_id, CAST(label AS INT) AS label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(l), 6) AS mean_intensity FROM m JOIN n ON n.image_id = m.image_id AND n.i = m.i GROUP BY 1, 2"
)
ORACLES["flood_select"] = (
    f"WITH RECURSIVE {PX}, s AS (SELECT image_id, r AS sr, g AS sg, b AS sb FROM px WHERE x = 4 AND y = 4), m AS (SELECT image_id, y, x FROM px JOIN s USING (image_id) WHERE (r-sr)*(r-sr)::DOUBLE + (g-sg)*(g-sg)::DOUBLE + (b-sb)*(b-sb)::DOUBLE <= 9000.0*9000), "
    "t AS (SELECT image_id, y, x FROM m WHERE x = 4 AND y = 4 UNION SELECT m.image_id, m.y, m.x FROM t JOIN m ON m.image_id = t.image_id AND abs(m.y-t.y) + abs(m.x-t.x) = 1) SELECT px.image_id, px.y, px.x, CASE WHEN t.x IS NULL THEN 0 ELSE 65535 END AS v FROM px LEFT JOIN t ON t.image_id = px.image_id AND t.y = px.y AND t.x = px.x"
)
_STEPS_TO = "greatest(abs(q.x-p.x), abs(q.y-p.y)) + (sqrt(2.0::DOUBLE) - 1)*least(abs(q.x-p.x), abs(q.y-p.y))"
ORACLES["distance_transform"] = f"WITH {PX}, {_LIGHT}, d AS (SELECT p.image_id, p.y, p.x, CASE WHEN any_value(p.l) < 0.5 THEN 0.0::DOUBLE ELSE coalesce(min({_STEPS_TO}) FILTER (WHERE q.l < 0.5), 8.0) END AS d FROM l p JOIN l q ON q.image_id = p.image_id GROUP BY 1, 2, 3) SELECT image_id, y, x, CAST(floor(CASE WHEN max(d) OVER i > 0 THEN round(d/max(d) OVER i*65535, 6) ELSE 0 END + 0.5) AS INT) AS v FROM d WINDOW i AS (PARTITION BY image_id)"

# --- the whole-image forms of operators whose pixel tables have SQL ------------------------------------------------------------------

#: Values from sums in single precision are compared in steps of 256: the last digits of a sum are its order's.
_STEPS = "CAST(floor(({c} + 128)/256.0) AS INT)"


def _framed(name: str, f, of: str, exact: bool) -> None:
    def run(spark, sf_dir: str):
        out = codecs.to_pixels(f(frames.from_pixels(rasters.rgb(spark, sf_dir)))).select(*KEY, *RGB)
        return out if exact else out.select(*KEY, *[F.floor((F.col(c) + 128) / 256).cast("int").alias(c) for c in RGB])

    register(name, run, ORACLES[of] if exact else f"SELECT image_id, y, x, {_each(_STEPS)} FROM ({ORACLES[of]}) o")


def _gathered(sql: str) -> str:
    """Rows of one channel each as wide ones."""
    return f"SELECT image_id, y, x, {', '.join(f'max(CASE WHEN c = {k} THEN v END) AS {n}' for k, n in enumerate(RGB))} FROM ({sql}) o GROUP BY 1, 2, 3"


register("frames_equalize", lambda s, d: codecs.to_pixels(frames.equalize(frames.from_pixels(rasters.rgb(s, d)))).select(*KEY, *RGB), _gathered(ORACLES["equalize"]))
_framed("frames_gaussian_blur", lambda i: frames.gaussian_blur(i, 0.6), "gaussian_blur", False)
_framed("frames_sharpen", lambda i: frames.sharpen(i, 0.6, 1.3), "sharpen", False)
_framed("frames_motion_blur", lambda i: frames.motion_blur(i, 2, 1.0, 30.0), "motion_blur", False)


def _pairs(measure, name: str):
    def run(spark, sf_dir: str):
        images = frames.from_pixels(rasters.rgb(spark, sf_dir))
        after = images.withColumn("image_id", F.col("image_id") - 1)
        return measure(images, after).select("image_id", F.round(F.round(name, 9), 5).alias(name))

    return run


for _measure, _name, _of in ((frames.mse, "mse", "compare_measures"), (frames.ssim, "ssim", "compare_ssim")):
    register(f"frames_{_name}", _pairs(_measure, _name), f"SELECT image_id, round({_name}, 5) AS {_name} FROM ({ORACLES[_of]}) o")


def _over(spark, sf_dir: str):
    """A fading patch over the lower right of every image."""
    patch = np.zeros((4, 5, 4), int)
    patch[..., :3], patch[..., 3] = (60000, 30000, 1000), np.arange(20).reshape(4, 5) * 3449
    return codecs.to_pixels(frames.composite_over(frames.from_pixels(rasters.rgb(spark, sf_dir)), patch, 4, 5)).select(*KEY, *[F.floor((F.col(c) + 8) / 16).cast("int").alias(c) for c in RGB])


_SHARE = "((y-5)*5 + x-4)*3449/65535.0::DOUBLE"
register("frames_composite", _over, f"WITH {PX} SELECT image_id, y, x, {', '.join(f'CAST(floor((CASE WHEN y >= 5 AND x >= 4 THEN floor({c} + ({k} - {c})*{_SHARE} + 0.5) ELSE {c} END + 8)/16) AS INT) AS {c}' for c, k in zip(RGB, (60000, 30000, 1000), strict=True))} FROM px")
register("frames_encode_png", lambda s, d: codecs.to_pixels(codecs.decode(frames.encode(frames.from_pixels(rasters.rgb(s, d)), "png").withColumn("path", F.lit("x.png")))).select(*KEY, *RGB), f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px")


for _method in ("lanczos3", "catrom", "triangle"):
    _framed(f"frames_resize_{_method}", lambda i, m=_method: frames.resize(i, 12, 5, m), f"resize_{_method}", False)
