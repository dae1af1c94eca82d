"""Registered queries on whole images as rows: files of several images, and operators that see more than a neighbourhood."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import PX, RGB, register
from .functions.quantum import M
from .operators import attention, creative, frames, layer_trees, palettes, retouch, selection, stacks, stitching, textures
from .sources import codecs, image_files, rasters

#: Images of a sequence in the queries below.
LENGTH = 10


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three embeddings an image, a row an image."""
    return frames.from_pixels(rasters.rgb(spark, sf_dir))


def _sequence(kind: str):
    """Every ten images as one file; the files are written, then read again by the data source, an image a row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _images(spark, sf_dir).select("*", F.floor(F.col("image_id") / LENGTH).alias("seq_id"), F.col("image_id").alias("scene"), ((F.col("image_id") % LENGTH) * 10 + 20).cast("int").alias("delay_ms"))
        spark.dataSource.register(image_files.ImageFrames)
        path = image_files.scratch(spark, f"sequence-{kind}")
        image_files.encoded_sequences(rows, kind).write.format("image_frames").mode("append").save(path)
        read = spark.read.format("image_frames").schema("path string, frame int, width int, channels int, delay_ms int, data binary").load(path)
        number = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long") * LENGTH + F.col("frame")
        whole = read.select(number.alias("image_id"), "width", "channels", "data", "delay_ms")
        return codecs.to_pixels(whole, ["delay_ms"]).select("image_id", "y", "x", *RGB, "delay_ms")

    return run


_BYTE = "CAST(floor({c}/257.0+0.5) AS INT)*257"
for _kind in ("gif", "png", "webp", "tiff", "tiff_tiled"):
    _value = "{c}" if _kind in ("png", "tiff", "tiff_tiled") else _BYTE
    _delay = "CAST(0 AS INT)" if _kind.startswith("tiff") else f"CAST(image_id % {LENGTH} * 10 + 20 AS INT)"
    register(f"sequence_{_kind}", _sequence(_kind), f"WITH {PX} SELECT image_id, y, x, {', '.join(_value.format(c=c) + f' AS {c}' for c in RGB)}, {_delay} AS delay_ms FROM px")


def _fax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level pages through group 4 files, page by page."""
    spark.dataSource.register(image_files.ImageFrames)
    path = image_files.scratch(spark, "fax")
    rows = _images(spark, sf_dir).select("*", F.floor(F.col("image_id") / LENGTH).alias("seq_id"), F.col("image_id").alias("scene"), F.lit(0).alias("delay_ms"))
    image_files.encoded_sequences(rows, "tiff_fax").write.format("image_frames").mode("append").save(path)
    read = spark.read.format("image_frames").schema("path string, frame int, width int, channels int, data binary").load(path)
    number = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long") * LENGTH + F.col("frame")
    return codecs.to_pixels(read.select(number.alias("image_id"), "width", "channels", "data")).select("image_id", "y", "x", *RGB)


_LUMA = "(r*CAST(0.2126 AS DOUBLE) + g*CAST(0.7152 AS DOUBLE) + b*CAST(0.0722 AS DOUBLE))"
register("sequence_fax", _fax, f"WITH {PX} SELECT image_id, y, x, {', '.join(f'CASE WHEN {_LUMA} < 32767.5 THEN 0 ELSE 65535 END AS {c}' for c in RGB)} FROM px")
register("codec_webp", lambda s, d: codecs.to_pixels(codecs.decode(frames.encode(_images(s, d), "webp").withColumn("path", F.lit("x.webp")))).select("image_id", "y", "x", *RGB), f"WITH {PX} SELECT image_id, y, x, {', '.join(_BYTE.format(c=c) + f' AS {c}' for c in RGB)} FROM px")

# --- stacks -------------------------------------------------------------------------------------------------------------------------


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three images as one stack."""
    return _images(spark, sf_dir).withColumn("seq_id", F.floor(F.col("image_id") / 3)).withColumn("z", (F.col("image_id") % 3).cast("int"))


def _pixels(images: DataFrame) -> DataFrame:
    return codecs.to_pixels(images).select("image_id", "y", "x", *RGB)


_STACK = f"{PX}, st AS (SELECT image_id // 3 AS seq, image_id % 3 AS z, y, x, r, g, b, {_LUMA} AS l FROM px)"
_UNIT = {c: f"({c}::DOUBLE / 65535)" for c in RGB}
_HAT = "CASE WHEN l/65535 <= 0.5 THEN 2*(l/65535) ELSE 2*(1 - l/65535) END"
register(
    "hdr_merge",
    lambda s, d: _pixels(stacks.hdr_merge(_stacks(s, d).withColumn("stops", F.col("z") - 1), "stops")),
    f"WITH {_STACK}, w AS (SELECT *, {_HAT} AS w FROM st), m AS (SELECT seq, y, x, sum(w ORDER BY z) AS sw, {', '.join(f'sum(w*({u}/pow(2.0::DOUBLE, z - 1)) ORDER BY z) AS {c}' for c, u in _UNIT.items())} FROM w GROUP BY 1,2,3), "
    f"a AS (SELECT seq, y, x, {', '.join(f'CASE WHEN sw > 0 THEN {c}/sw ELSE 0 END AS {c}' for c in RGB)} FROM m), t AS (SELECT seq, max(greatest(r, g, b)) AS top FROM a GROUP BY 1) "
    f"SELECT seq AS image_id, y, x, {', '.join(f'CAST(trunc(least({c} * CASE WHEN top > 0 THEN 65535/top ELSE 1 END, 65535)) AS INT) AS {c}' for c in RGB)} FROM a JOIN t USING (seq)",
)
_NEAR = "PARTITION BY seq, z, {a} ORDER BY {b}"
_SIDES = {n: f"{f}({{v}}) OVER (PARTITION BY seq, z, {a} ORDER BY {b})" for n, f, a, b in (("u", "lag", "x", "y"), ("d", "lead", "x", "y"), ("e", "lag", "y", "x"), ("f", "lead", "y", "x"))}
_MEAN = f"(({' + '.join(_UNIT.values())})/3.0)"
_EXPOSED = " * ".join(f"exp(-12.5*({u}-0.5)*({u}-0.5))" for u in _UNIT.values())
_SPREAD = f"sqrt(({' + '.join(f'({u}-{_MEAN})*({u}-{_MEAN})' for u in _UNIT.values())})/3.0)"
_LUM = f"(0.2126::DOUBLE*{_UNIT['r']} + 0.7152::DOUBLE*{_UNIT['g']} + 0.0722::DOUBLE*{_UNIT['b']})"
register(
    "exposure_fusion",
    lambda s, d: _pixels(stacks.exposure_fusion(_stacks(s, d))),
    f"WITH {_STACK}, k AS (SELECT *, {_LUM} AS lu FROM st), n AS (SELECT *, {', '.join(f'{v.format(v=chr(108) + chr(117))} AS s{n}' for n, v in _SIDES.items())} FROM k), "
    f"w AS (SELECT *, (CASE WHEN su IS NULL OR sd IS NULL OR se IS NULL OR sf IS NULL THEN 0 ELSE abs(4*lu - su - sd - se - sf) END + 1e-10::DOUBLE) * ({_SPREAD} + 1e-10::DOUBLE) * ({_EXPOSED}) + 1e-12::DOUBLE AS w FROM n) "
    f"SELECT seq AS image_id, y, x, {', '.join(f'CASE WHEN count(*) = 1 THEN max({c}) ELSE CAST(trunc(sum({c}*w ORDER BY z) / sum(w ORDER BY z)) AS INT) END AS {c}' for c in RGB)} FROM w GROUP BY 1,2,3",
)
_LAPLACE = " + ".join(f"abs(4*{c} - {c}u - {c}d - {c}e - {c}f)" for c in RGB)
_FOCUS = (
    f"{_STACK}, n AS (SELECT *, {', '.join(f'{v.format(v=c)} AS {c}{n}' for c in RGB for n, v in _SIDES.items())} FROM st), f AS (SELECT *, coalesce({_LAPLACE}, 0) AS sharp FROM n), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY seq, y, x ORDER BY sharp DESC, z) AS k FROM f), b AS (SELECT seq, y, x, z FROM o WHERE k = 1), "
    "c AS (SELECT p.seq, p.y, p.x, q.z, count(*) AS n FROM b p JOIN b q ON q.seq = p.seq AND abs(q.y-p.y) <= 2 AND abs(q.x-p.x) <= 2 GROUP BY 1,2,3,4), "
    "j AS (SELECT *, row_number() OVER (PARTITION BY seq, y, x ORDER BY n DESC, z) AS k FROM c)"
)
register("focus_stack", lambda s, d: _pixels(stacks.focus_stack(_stacks(s, d))), f"WITH {_FOCUS} SELECT st.seq AS image_id, st.y, st.x, st.r, st.g, st.b FROM st JOIN j ON j.seq = st.seq AND j.y = st.y AND j.x = st.x AND j.z = st.z WHERE j.k = 1")

# --- interest -----------------------------------------------------------------------------------------------------------------------

_GRAY = "CAST(trunc(0.299::DOUBLE*({r}) + 0.587::DOUBLE*({g}) + 0.114::DOUBLE*({b})) AS INT)".format(**{c: f"{u}*255" for c, u in _UNIT.items()})
_BIN = " + ".join(f"{k}*least(CAST(trunc({u}*255) AS INT) // 42, 5)" for k, u in zip((36, 6, 1), _UNIT.values(), strict=True))
_AT = {n: f"{f}(v, 1) OVER (PARTITION BY image_id, {a} ORDER BY {b})" for n, f, a, b in (("w", "lag", "y", "x"), ("e", "lead", "y", "x"))}
_INTEREST = (
    f"{PX}, g AS (SELECT *, {_GRAY} AS v, {_BIN} AS bin FROM px), h AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in _AT.items())} FROM g), "
    "s AS (SELECT *, (e - w) + 2*0 AS dx, w + 2*v + e AS sm FROM h), "
    "q AS (SELECT *, lag(dx) OVER c AS dn, lead(dx) OVER c AS ds, lag(sm) OVER c AS sn, lead(sm) OVER c AS ss FROM s WINDOW c AS (PARTITION BY image_id, x ORDER BY y)), "
    "ed AS (SELECT image_id, y, x, coalesce(sqrt(((dn + 2*dx + ds)*(dn + 2*dx + ds) + (ss - sn)*(ss - sn))::DOUBLE), 0) AS edge FROM q), "
    "wc AS (SELECT p.image_id, p.y, p.x, q.v, count(*) AS n FROM g p JOIN g q ON q.image_id = p.image_id AND abs(q.y-p.y) <= 8 AND abs(q.x-p.x) <= 8 GROUP BY 1,2,3,4), "
    "wt AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY image_id, y, x) AS share FROM wc), "
    "en AS (SELECT image_id, y, x, -sum(share*log2(share) ORDER BY v) AS entropy FROM wt GROUP BY 1,2,3), "
    "hb AS (SELECT image_id, bin, count(*) AS n FROM g GROUP BY 1,2), ht AS (SELECT *, max(n) OVER (PARTITION BY image_id) AS top, sum(n) OVER (PARTITION BY image_id) AS total FROM hb), "
    "ra AS (SELECT image_id, bin, CASE WHEN n < top*0.1::DOUBLE THEN ln(1 + total::DOUBLE/n) ELSE 0 END AS rare FROM ht)"
)
_HEAT = ("CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN (t-0.5)/0.25*65535 ELSE 65535 END", "CASE WHEN t < 0.25 THEN 0 WHEN t < 0.5 THEN (t-0.25)/0.25*65535 WHEN t < 0.75 THEN 65535 ELSE 65535 - (t-0.75)/0.25*65535 END", "CASE WHEN t < 0.25 THEN t/0.25*65535 WHEN t < 0.5 THEN 65535 - (t-0.25)/0.25*65535 ELSE 0 END")
# no place's entropy or edge may be the sum of other orders to the last bit, so heat is compared in steps of 16
register(
    "interest_map",
    lambda s, d: _pixels(attention.interest_map(_images(s, d))).select("image_id", "y", "x", *[F.floor((F.col(c) + 8) / 16).cast("int").alias(c) for c in RGB]),
    f"WITH {_INTEREST}, m AS (SELECT image_id, y, x, least(1, entropy / greatest(max(entropy) OVER i, CASE WHEN max(entropy) OVER i < 1e-6 THEN 1 ELSE 0 END)*0.67::DOUBLE + edge / greatest(max(edge) OVER i, CASE WHEN max(edge) OVER i < 1e-6 THEN 1 ELSE 0 END)*0.33::DOUBLE) AS t FROM en JOIN ed USING (image_id, y, x) WINDOW i AS (PARTITION BY image_id)) "
    f"SELECT image_id, y, x, {', '.join(f'CAST(floor((trunc({v}) + 8) / 16) AS INT) AS {c}' for v, c in zip(_HEAT, RGB, strict=True))} FROM m",
)


def _crop_sql(tw: int, th: int) -> str:
    """Corners, foreground, scores of a coarse grid, then of every place about its best."""
    back = ", ".join(f"avg({u}) FILTER (WHERE (y = 0 OR y = 7) AND (x = 0 OR x = 7)) OVER (PARTITION BY image_id) AS k{c}" for c, u in _UNIT.items())
    away = " OR ".join(f"abs({u} - k{c}) > 0.15::DOUBLE" for c, u in _UNIT.items())
    score = f"sum(i.interest) * (1.0::DOUBLE - 0.6::DOUBLE*((py - t)::DOUBLE / greatest(1, bo - t)))"
    places = lambda ys, xs, step: f"SELECT image_id, l, t, ri, bo, bx, byy, py, px_ FROM {{src}} JOIN (SELECT unnest(range(0, {8 - th + 1})) AS py) a ON py BETWEEN {ys} {step('py', ys)} JOIN (SELECT unnest(range(0, {8 - tw + 1})) AS px_) b ON px_ BETWEEN {xs} {step('px_', xs)}"
    coarse = places(f"greatest(0, t - {th // 4}) AND least({8 - th}, bo - {th // 4})", f"greatest(0, l - {tw // 4}) AND least({8 - tw}, ri - {tw // 2})", lambda v, r: f"AND ({v} - {r.split(' AND ')[0]}) % 2 = 0")
    fine = places(f"greatest(0, byy - 4) AND least({8 - th}, byy + 4)", f"greatest(0, bx - 4) AND least({8 - tw}, bx + 4)", lambda v, r: "")
    scored = lambda name: f"SELECT p.image_id, l, t, ri, bo, py, px_, {score} AS score FROM {name} p JOIN it i ON i.image_id = p.image_id AND i.y BETWEEN py AND py + {th - 1} AND i.x BETWEEN px_ AND px_ + {tw - 1} GROUP BY p.image_id, l, t, ri, bo, py, px_"
    return (
        f"WITH {_INTEREST}, it AS (SELECT image_id, y, x, rare*2 + entropy + ln(1 + edge)*0.1::DOUBLE AS interest FROM g JOIN ra USING (image_id, bin) JOIN en USING (image_id, y, x) JOIN ed USING (image_id, y, x)), "
        f"ba AS (SELECT image_id, y, x, r, g, b, {back} FROM px), fo AS (SELECT image_id, min(x) AS l, min(y) AS t, max(x) AS ri, max(y) AS bo FROM ba WHERE {away} GROUP BY 1), "
        f"fb AS (SELECT image_id, CASE WHEN ok THEN l ELSE 0 END AS l, CASE WHEN ok THEN t ELSE 0 END AS t, CASE WHEN ok THEN ri + 1 ELSE 8 END AS ri, CASE WHEN ok THEN bo + 1 ELSE 8 END AS bo FROM (SELECT i.image_id, l, t, ri, bo, coalesce(l < ri AND t < bo, FALSE) AS ok FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN fo USING (image_id))), "
        f"st AS (SELECT *, least(greatest(CASE WHEN ri - l <= {tw} THEN (l + ri) // 2 - {tw // 2} ELSE l END, 0), {8 - tw}) AS bx, least(greatest(CASE WHEN bo - t <= {th} THEN t ELSE t + CAST(trunc((bo - t)*0.1::DOUBLE) AS INT) END, 0), {8 - th}) AS byy FROM fb), "
        f"co AS ({coarse.format(src='st')}), cs AS ({scored('co')}), cb AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, py, px_) AS k FROM cs), "
        f"fs AS (SELECT st.image_id, st.l, st.t, st.ri, st.bo, coalesce(cb.px_, st.bx) AS bx, coalesce(cb.py, st.byy) AS byy, cb.score AS best FROM st LEFT JOIN cb ON cb.image_id = st.image_id AND cb.k = 1), "
        f"fi AS ({fine.format(src='fs')}), fc AS ({scored('fi')}), fk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, py, px_) AS k FROM fc) "
        f"SELECT fs.image_id, CAST(CASE WHEN best IS NULL OR fk.score > best + 1e-9 THEN fk.px_ ELSE bx END AS INT) AS x, CAST(CASE WHEN best IS NULL OR fk.score > best + 1e-9 THEN fk.py ELSE byy END AS INT) AS y, {tw} AS width, {th} AS height FROM fs JOIN fk ON fk.image_id = fs.image_id AND fk.k = 1"
    )


register("smart_crop", lambda s, d: attention.regions(_images(s, d), 4, 3), _crop_sql(4, 3))

# --- layers -------------------------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every image and the next as a document: a base, a masked layer, an adjustment, a group of two with clipping, a hidden layer."""
    images = _images(spark, sf_dir)
    doc = F.col("image_id")
    row = lambda z, depth, kind, image=None, mask=None, mode=None, opacity=None, visible=None, clipped=None, dx=None, dy=None, adjustment=None: F.struct(
        F.lit(z).alias("z"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), (F.lit(None) if image is None else doc + image).cast("long").alias("image_id"), (F.lit(None) if mask is None else doc + mask).cast("long").alias("mask_id"), F.lit(mode).cast("string").alias("mode"),
        F.lit(opacity).cast("double").alias("opacity"), F.lit(visible).cast("boolean").alias("visible"), F.lit(clipped).cast("boolean").alias("clipped"), F.lit(dx).cast("int").alias("dx"), F.lit(dy).cast("int").alias("dy"), F.lit(adjustment).cast("string").alias("adjustment"),
    )
    rows = [row(0, 0, "layer", 0), row(1, 0, "layer", 1, 0, "multiply", 0.75), row(2, 0, "adjustment", opacity=0.5, adjustment="invert"), row(3, 0, "group", mode="screen", opacity=0.5), row(4, 1, "layer", 0, dx=2, dy=3), row(5, 1, "layer", 1, mode="difference", clipped=True), row(6, 0, "layer", 1, visible=False)]
    layers = images.select(doc.alias("doc_id"), F.explode(F.array(*rows)).alias("l")).select("doc_id", "l.*")
    return layers, images


def _flattened(change=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layers, images = _tree(spark, sf_dir)
        if change:
            layers, images = change(layers, images)
        return codecs.to_pixels(layer_trees.flatten(layers, images, 8, 8)).select("image_id", "y", "x", *RGB, "a")

    return run


def _flat_sql(steps: list[str]) -> str:
    """Steps one after another on (image_id, y, x, r, g, b, a) and the second image's r2, g2, b2."""
    head = f"WITH {PX}, nx AS (SELECT image_id - 1 AS image_id, y, x, r AS r2, g AS g2, b AS b2 FROM px), b0 AS (SELECT px.image_id, px.y, px.x, px.r AS r1, px.g AS g1, px.b AS b1, r2, g2, b2, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM px LEFT JOIN nx USING (image_id, y, x))"
    for k, step in enumerate(steps):
        head += f", b{k + 1} AS ({step.replace('{from}', f'b{k}')})"
    return f"{head} SELECT image_id, y, x, r, g, b, a FROM b{len(steps)}"


_ROUND = "CAST(floor(least(greatest(({v})*65535, 0), 65535) + 0.5) AS INT)"
_KEPT = "image_id, y, x, r1, g1, b1, r2, g2, b2"


def _mixed(mode: str, over: str, alpha: str, present: str) -> str:
    """A mode that is mixed by alpha; ``over`` has {c} for the channel."""
    new = {"multiply": "({b})*({o})", "screen": "1-(1-({b}))*(1-({o}))", "difference": "abs(({b})-({o}))"}[mode]
    value = lambda c: _ROUND.format(v=f"{c}/65535.0::DOUBLE*(1-({alpha})/65535.0::DOUBLE) + ({new.format(b=f'{c}/65535.0::DOUBLE', o=over.format(c=c) + '/65535.0::DOUBLE')})*(({alpha})/65535.0::DOUBLE)")
    a = _ROUND.format(v=f"({alpha})/65535.0::DOUBLE + a/65535.0::DOUBLE*(1-({alpha})/65535.0::DOUBLE)")
    return f"SELECT {_KEPT}, {', '.join(f'CASE WHEN {present} THEN {value(c)} ELSE {c} END AS {c}' for c in RGB)}, CASE WHEN {present} THEN {a} ELSE a END AS a FROM {{from}}"


_BASE = f"SELECT {_KEPT}, {', '.join(f'{c}1 AS {c}' for c in RGB)}, 65535 AS a FROM {{from}}"
_MASKED = _mixed("multiply", "{c}2", "CAST(trunc(1.0::DOUBLE*0.75*(r1/65535.0::DOUBLE)*65535) AS INT)", "r2 IS NOT NULL")
_INVERT = f"SELECT {_KEPT}, {', '.join(f'CAST(trunc({c}*0.5::DOUBLE + (65535-{c})*0.5::DOUBLE) AS INT) AS {c}' for c in RGB)}, CAST(trunc(a*0.5::DOUBLE + a*0.5::DOUBLE) AS INT) AS a FROM {{from}}"
# the group's own canvas: the first image at (2, 3), then the difference with the second, clipped to what is there
_SHIFTED = ", ".join(f"q.{c}1 AS {c}q" for c in RGB)
_DIFF = lambda c: f"CASE WHEN {c}2 IS NULL OR {c}q IS NULL THEN coalesce({c}q, 0) ELSE " + _ROUND.format(v=f"{c}q/65535.0::DOUBLE*0.0 + abs({c}q/65535.0::DOUBLE - {c}2/65535.0::DOUBLE)") + " END"
_GROUP = f"SELECT p.*, {', '.join(f'{_DIFF(c)} AS {c}g' for c in RGB)}, CASE WHEN rq IS NULL THEN 0 ELSE 65535 END AS ag FROM (SELECT p.*, {_SHIFTED} FROM {{from}} p LEFT JOIN {{from}} q ON q.image_id = p.image_id AND q.y = p.y - 3 AND q.x = p.x - 2) p"
_SCREEN = _mixed("screen", "{c}g", "CAST(trunc(ag/65535.0::DOUBLE*0.5*65535) AS INT)", "TRUE")
register("layers_flatten", _flattened(), _flat_sql([_BASE, _MASKED, _INVERT, _GROUP, _SCREEN]))
register("layers_removed", _flattened(lambda layers, images: (layer_trees.removed(layers, 2), images)), _flat_sql([_BASE, _MASKED, _GROUP, _SCREEN]))
register("layers_moved", _flattened(lambda layers, images: (layer_trees.moved(layers, 2, 0), images)), _flat_sql([f"SELECT {_KEPT}, 65535//2 AS r, 65535//2 AS g, 65535//2 AS b, 0 AS a FROM {{from}}", _BASE, _MASKED, _GROUP, _SCREEN]))
register("layers_merged", _flattened(lambda layers, images: layer_trees.merged(layers, images, 0, 3, 8, 8, 1 << 40)), _flat_sql([_BASE, _MASKED, _INVERT, _GROUP, _SCREEN]))

# --- selection ----------------------------------------------------------------------------------------------------------------------


def _trimap(p: np.ndarray) -> np.ndarray:
    """The border is background, the four pixels in the middle are foreground."""
    out = np.full((*p.shape[:2], 1), M // 2)
    out[0] = out[-1] = out[:, 0] = out[:, -1] = 0
    out[3:5, 3:5] = M
    return out


def _hole(p: np.ndarray) -> np.ndarray:
    out = np.zeros((*p.shape[:2], 1))
    out[2:6, 3:6] = M
    return out


def _values(images: DataFrame) -> DataFrame:
    """image_id, y, x, v of images of one channel."""
    return codecs.to_pixels(images).select("image_id", "y", "x", F.col("r").alias("v"))


def _with(other, f):
    """A query on every image and what is made of it beside it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        images = _images(spark, sf_dir)
        return f(images, frames.apply(images, other))

    return run


_KNOWN = "k AS (SELECT *, CASE WHEN y IN (0, 7) OR x IN (0, 7) THEN 0 WHEN y IN (3, 4) AND x IN (3, 4) THEN 1 ELSE 2 END AS side FROM px)"
_FAR = " + ".join(f"(p.{c}::DOUBLE/65535 - q.{c}::DOUBLE/65535)*(p.{c}::DOUBLE/65535 - q.{c}::DOUBLE/65535)" for c in RGB)
register(
    "alpha_matting",
    _with(_trimap, lambda i, t: _values(selection.alpha_matting(i, t, 4))),
    f"WITH {PX}, {_KNOWN}, d AS (SELECT p.image_id, p.y, p.x, q.side, {_FAR} + ((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y))/100.0::DOUBLE*0.1::DOUBLE AS d FROM k p JOIN k q ON q.image_id = p.image_id AND q.side < 2 WHERE p.side = 2), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x, side ORDER BY d) AS n FROM d), s AS (SELECT image_id, y, x, side, sum(exp(-d/(200.0::DOUBLE + 1e-12))*d)/sum(exp(-d/(200.0::DOUBLE + 1e-12))) AS d FROM n WHERE n <= 4 GROUP BY 1,2,3,4), "
    "a AS (SELECT image_id, y, x, max(CASE WHEN side = 1 THEN d END) AS f, max(CASE WHEN side = 0 THEN d END) AS b FROM s GROUP BY 1,2,3) "
    "SELECT k.image_id, k.y, k.x, CASE WHEN side = 0 THEN 0 WHEN side = 1 THEN 65535 WHEN a.f + a.b > 1e-12 THEN CAST(trunc(a.b/(a.f + a.b)*65535) AS INT) ELSE 32767 END AS v FROM k LEFT JOIN a USING (image_id, y, x)",
)
register("knn_matting", _with(_trimap, lambda i, t: _values(selection.knn_matting(i, t, 6, 3))))
register("grab_cut", _with(_trimap, lambda i, t: _values(selection.grab_cut(i, t))))
register("remove_background", lambda s, d: codecs.to_pixels(selection.remove_background(_images(s, d))).select("image_id", "y", "x", *RGB, "a"))


def _box(of: str, source: str, radius: int) -> str:
    return f"SELECT p.image_id, p.y, p.x, sum(q.{of})/count(*) AS m FROM {source} p JOIN {source} q ON q.image_id = p.image_id AND abs(q.y-p.y) <= {radius} AND abs(q.x-p.x) <= {radius} GROUP BY 1,2,3"


# the last digits depend on the order of sums, so steps of 16 are compared
register(
    "saliency_map",
    lambda s, d: _values(selection.saliency_map(_images(s, d))).select("image_id", "y", "x", F.floor((F.col("v") + 8) / 16).cast("int").alias("v")),
    f"WITH {PX}, l AS (SELECT image_id, y, x, {_LUMA}/65535 AS l FROM px), {', '.join(f'm{k} AS ({_box(chr(108), chr(108), k // 2)})' for k in (3, 7, 15, 31))}, "
    "s AS (SELECT image_id, y, x, abs(l - m3.m) + abs(l - m7.m) + abs(l - m15.m) + abs(l - m31.m) AS s FROM l JOIN m3 USING (image_id, y, x) JOIN m7 USING (image_id, y, x) JOIN m15 USING (image_id, y, x) JOIN m31 USING (image_id, y, x)), "
    f"n AS (SELECT image_id, y, x, s / CASE WHEN max(s) OVER i > 0 THEN max(s) OVER i ELSE 1 END AS s FROM s WINDOW i AS (PARTITION BY image_id)), b AS ({_box('s', 'n', 5)}) "
    "SELECT image_id, y, x, CAST(floor((trunc(m / CASE WHEN max(m) OVER i > 0 THEN max(m) OVER i ELSE 1 END * 65535) + 8) / 16) AS INT) AS v FROM b WINDOW i AS (PARTITION BY image_id)",
)

# --- retouching ---------------------------------------------------------------------------------------------------------------------

register("inpaint", _with(_hole, lambda i, m: _pixels(retouch.inpaint(i, m, 3))))
register("inpaint_edges", _with(_hole, lambda i, m: _pixels(retouch.inpaint_edges(i, m, 3, 10))))
register("patch_fill", _with(_hole, lambda i, m: _pixels(retouch.patch_fill(i, m, 3))))
register("remove_object", _with(_hole, lambda i, m: _pixels(retouch.remove_object(i, m, 3, 1.0))))


def _dot(p: np.ndarray) -> np.ndarray:
    out = np.zeros((*p.shape[:2], 1))
    out[4, 3] = M
    return out


# a hole of one pixel has no order: the weighted mean of its surroundings
register("inpaint_dot", _with(_dot, lambda i, m: _pixels(retouch.inpaint(i, m, 3))), f"WITH {PX}, w AS (SELECT *, 1.0::DOUBLE/((y-4)*(y-4) + (x-3)*(x-3)) AS w FROM px WHERE (y-4)*(y-4) + (x-3)*(x-3) BETWEEN 1 AND 9), m AS (SELECT image_id, {', '.join(f'CAST(trunc(sum({c}*w)/sum(w) + 0.5) AS INT) AS m{c}' for c in RGB)} FROM w GROUP BY 1) SELECT image_id, y, x, {', '.join(f'CASE WHEN y = 4 AND x = 3 THEN m{c} ELSE {c} END AS {c}' for c in RGB)} FROM px JOIN m USING (image_id)")
_STAMP = f"{PX}, st AS (SELECT p.*, {', '.join(f'q.{c} AS s{c}' for c in RGB)} FROM px p LEFT JOIN px q ON q.image_id = p.image_id AND p.y BETWEEN 4 AND 7 AND p.x BETWEEN 3 AND 7 AND q.y = p.y - 3 AND q.x = p.x - 3)"
register("clone_stamp", lambda s, d: _pixels(retouch.clone_stamp(_images(s, d), 0, 1, 3, 4, 6, 5)), f"WITH {_STAMP} SELECT image_id, y, x, {', '.join(f'coalesce(s{c}, {c}) AS {c}' for c in RGB)} FROM st")
_OUTLINE = "(y IN ({a}, {a} + 3) OR x IN ({b}, {b} + 4)) AND y BETWEEN {a} AND {a} + 3 AND x BETWEEN {b} AND {b} + 4"
register(
    "healing_brush",
    lambda s, d: _pixels(retouch.healing_brush(_images(s, d), 0, 1, 3, 4, 6, 5)),
    f"WITH {_STAMP}, o AS (SELECT image_id, {', '.join(f'avg({c}) FILTER (WHERE {_OUTLINE.format(a=4, b=3)}) - avg({c}) FILTER (WHERE {_OUTLINE.format(a=1, b=0)}) AS off_{c}' for c in RGB)} FROM px GROUP BY 1), "
    f"w AS (SELECT *, least(least(y-4, 7-y)/2.0::DOUBLE, 1)*least(least(x-3, 7-x)/2.0::DOUBLE, 1) AS w FROM st JOIN o USING (image_id)) SELECT image_id, y, x, {', '.join(f'CASE WHEN s{c} IS NULL THEN {c} ELSE CAST(trunc(least(greatest(s{c} + off_{c}*w + 0.5, 0), 65535)) AS INT) END AS {c}' for c in RGB)} FROM w",
)
_RED = "CASE WHEN g + b > 65.535 THEN (r/65535.0::DOUBLE)/((g/65535.0::DOUBLE + b/65535.0::DOUBLE)*0.5 + r/65535.0::DOUBLE) ELSE 0 END"
register(
    "red_eye",
    lambda s, d: _pixels(retouch.red_eye(_images(s, d), 3, 4, 3, 0.5)),
    f"WITH {PX}, e AS (SELECT *, {_RED} AS red FROM px), f AS (SELECT *, least(greatest((red - 0.5)/0.5, 0), 1) AS s FROM e) SELECT image_id, y, x, CASE WHEN (y-4)*(y-4) + (x-3)*(x-3) <= 9 AND red > 0.5 THEN CAST(trunc(least((r/65535.0::DOUBLE*(1-s) + (0.299::DOUBLE*(r/65535.0::DOUBLE) + 0.587::DOUBLE*(g/65535.0::DOUBLE) + 0.114::DOUBLE*(b/65535.0::DOUBLE))*s)*65535 + 0.5, 65535)) AS INT) ELSE r END AS r, g, b FROM f",
)

# --- textures and palettes ----------------------------------------------------------------------------------------------------------

_FADE = lambda a, b, t: f"CAST(floor({a}*{t} + {b}*(1-{t}) + 0.5) AS INT)"
_H = f"{PX}, o AS (SELECT p.*, {', '.join(f'q.{c} AS q{c}' for c in RGB)}, CASE WHEN p.x < 2 THEN p.x ELSE p.x - 6 END*0.5::DOUBLE AS t FROM px p LEFT JOIN px q ON q.image_id = p.image_id AND q.y = p.y AND q.x = CASE WHEN p.x < 2 THEN p.x + 6 WHEN p.x > 5 THEN p.x - 6 END), h AS (SELECT image_id, y, x, {', '.join(f'CASE WHEN q{c} IS NULL THEN {c} ELSE {_FADE(c, f'q{c}', 't')} END AS {c}' for c in RGB)} FROM o)"
register(
    "seamless_tile",
    lambda s, d: _pixels(textures.seamless_tile(_images(s, d))),
    f"WITH {_H}, v AS (SELECT p.*, {', '.join(f'q.{c} AS q{c}' for c in RGB)}, CASE WHEN p.y < 2 THEN p.y ELSE p.y - 6 END*0.5::DOUBLE AS t FROM h p LEFT JOIN h q ON q.image_id = p.image_id AND q.x = p.x AND q.y = CASE WHEN p.y < 2 THEN p.y + 6 WHEN p.y > 5 THEN p.y - 6 END) SELECT image_id, y, x, {', '.join(f'CASE WHEN q{c} IS NULL THEN {c} ELSE {_FADE(c, f'q{c}', 't')} END AS {c}' for c in RGB)} FROM v",
)
register("synthesize_texture", lambda s, d: _pixels(textures.synthesize(_images(s, d), 12, 10, 2, None)))
#: Fixed colours of the remapping query.
_COLORS = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (200, 120, 40), (60, 90, 160)]
_NEAREST = f"{PX}, pal AS (SELECT * FROM (VALUES {', '.join(f'({k}, {r}, {g}, {b})' for k, (r, g, b) in enumerate(_COLORS))}) v(k, pr, pg, pb)), q AS (SELECT image_id, y, x, {', '.join(f'CAST(floor({c}/257.0 + 0.5) AS INT) AS {c}' for c in RGB)} FROM px), n AS (SELECT q.*, pal.*, row_number() OVER (PARTITION BY image_id, y, x ORDER BY (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), k) AS n FROM q, pal)"
register("remap", lambda s, d: _pixels(palettes.remap(_images(s, d), np.array(_COLORS, np.uint8))), f"WITH {_NEAREST} SELECT image_id, y, x, pr*257 AS r, pg*257 AS g, pb*257 AS b FROM n WHERE n = 1")
register("remap_dithered", lambda s, d: _pixels(palettes.remap(_images(s, d), np.array(_COLORS, np.uint8), True)))
register("quantize", lambda s, d: _pixels(palettes.quantize(_images(s, d), 8, False)))
register("quantize_dithered", lambda s, d: _pixels(palettes.quantize(_images(s, d), 8)))
register("image_palettes", lambda s, d: palettes.palettes(_images(s, d), 8))
_OCT = " + ".join(f"(((CAST(floor({c}/257.0 + 0.5) AS INT) >> {bit}) & 1) << {3 * (bit - 3) + 2 - k})" for bit in range(7, 2, -1) for k, c in enumerate(RGB))
register("octree_cells", lambda s, d: palettes.cell_sums(_images(s, d)), f"WITH {PX} SELECT CAST({_OCT} AS INT) AS cell, count(*) AS n, {', '.join(f'CAST(sum(CAST(floor({c}/257.0 + 0.5) AS INT)) AS BIGINT) AS {c}' for c in RGB)} FROM px GROUP BY 1")


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return _pixels(palettes.remap(images, palettes.shared_palette(images, 32)))


register("shared_palette", _shared)

# --- stitching ----------------------------------------------------------------------------------------------------------------------


_enlarged = frames.resized(192, 192, "hermite")
#: Each image enlarged smoothly, as two views of 170 x 170, the second 17 to the right and 13 down.
_VIEWS = (lambda p: np.ascontiguousarray(_enlarged(p)[:170, :170]), lambda p: np.ascontiguousarray(_enlarged(p)[13:183, 17:187]))
_SECOND = 1 << 40


def _view_pairs(images: DataFrame) -> DataFrame:
    return images.select(F.col("image_id").alias("a"), (F.col("image_id") + _SECOND).alias("b"))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    first, second = (frames.apply(images, view) for view in _VIEWS)
    found = stitching.align(_view_pairs(images), stitching.features(first.unionByName(second.withColumn("image_id", F.col("image_id") + _SECOND))))
    h = lambda k: F.round(F.element_at("homography", k + 1), 2) + F.lit(0.0)
    return found.select(F.col("a").alias("image_id"), *[h(k).alias(f"h{k}") for k in range(8)], (F.col("inliers") >= 4).alias("agreed"))


register("align_views", _aligned, f"WITH {PX} SELECT DISTINCT image_id, 1.0::DOUBLE AS h0, 0.0::DOUBLE AS h1, -17.0::DOUBLE AS h2, 0.0::DOUBLE AS h3, 1.0::DOUBLE AS h4, -13.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, TRUE AS agreed FROM px")


def _stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each panorama of 187 x 183 is from the enlarged image (both views show it as it is), at most, in steps of 256."""
    images = _images(spark, sf_dir)
    seen = np.zeros((183, 187), bool)
    seen[:170, :170] = seen[13:, 17:] = True

    def away(p: np.ndarray, small: np.ndarray) -> dict[str, float]:
        q = _enlarged(small)[:183, :187]
        same = p.shape == q.shape
        return {"width": p.shape[1], "height": p.shape[0], "away": np.abs(p.astype(float) - q)[seen].max() // 256 if same else -1.0}

    # images are shuffled as they are stored, 576 times smaller than enlarged
    stitched = stitching.stitch(_view_pairs(images), images.unionByName(images.withColumn("image_id", F.col("image_id") + _SECOND)), views=_VIEWS, beside=True)
    return frames.measure_rows(stitched, away, ["width", "height", "away"])


register("stitch", _stitched, f"WITH {PX} SELECT DISTINCT image_id, 187.0::DOUBLE AS width, 183.0::DOUBLE AS height, 0.0::DOUBLE AS away FROM px")


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return _pixels(stitching.laplacian_blend(images, frames.apply(images, lambda p: M - p), frames.apply(images, _trimap), 3))


register("laplacian_blend", _banded)

# --- creative filters ---------------------------------------------------------------------------------------------------------------

_JIT = lambda gx, gy, k: f"((xor(xor({gx}*73856093, {gy}*19349663), {k}*83492791) & 2147483647) % 3)"
register(
    "crystallize",
    lambda s, d: _pixels(creative.crystallize(_images(s, d), 3, 7)),
    f"WITH {PX}, ce AS (SELECT gx, gy, least(gx*3 + {_JIT('gx', 'gy', 14)}, 7) AS cx, least(gy*3 + {_JIT('gx', 'gy', 15)}, 7) AS cy FROM (SELECT CAST(unnest([0, 1]) AS BIGINT) AS gx) a, (SELECT CAST(unnest([0, 1]) AS BIGINT) AS gy) b), "
    f"n AS (SELECT px.*, gx, gy, row_number() OVER (PARTITION BY image_id, y, x ORDER BY (x-cx)*(x-cx) + (y-cy)*(y-cy), gy, gx) AS k FROM px, ce WHERE abs(least(y//3, 1) - gy) <= 1 AND abs(least(x//3, 1) - gx) <= 1) "
    f"SELECT image_id, y, x, {', '.join(f'CAST(sum({c}) OVER w // count(*) OVER w AS INT) AS {c}' for c in RGB)} FROM n WHERE k = 1 WINDOW w AS (PARTITION BY image_id, gy, gx)",
)


def _ink(name: str, value: str, degrees: float) -> str:
    """Dots of a screen of three pixels at an angle: name(image_id, y, x, v)."""
    c, s = f"cos({degrees}*pi()/180)", f"sin({degrees}*pi()/180)"
    return (
        f"{name}0 AS (SELECT DISTINCT y, x, x*{c} + y*{s} AS rx, -x*{s} + y*{c} AS ry FROM px), {name}1 AS (SELECT *, floor(rx/3 + 0.5)*3 AS mx, floor(ry/3 + 0.5)*3 AS my FROM {name}0), "
        f"{name} AS (SELECT q.image_id, p.y, p.x, CASE WHEN (rx-mx)*(rx-mx) + (ry-my)*(ry-my) <= ({value})*2.25 THEN {value} ELSE 0 END AS v FROM {name}1 p JOIN ik q ON q.x = least(greatest(CAST(trunc(mx*{c} - my*{s}) AS INT), 0), 7) AND q.y = least(greatest(CAST(trunc(mx*{s} + my*{c}) AS INT), 0), 7))"
    )


_INKS = f"{PX}, ik0 AS (SELECT *, 1.0 - greatest(r, g, b)/65535.0::DOUBLE AS k FROM px), ik AS (SELECT *, CASE WHEN k < 1 THEN 1/(1-k) ELSE 0 END AS sh FROM ik0)"
_ANGLES = {"r": 15.0, "g": 75.0, "b": 0.0}
register(
    "halftone",
    lambda s, d: _pixels(creative.halftone(_images(s, d), 3)),
    f"WITH {_INKS}, {', '.join(_ink(f'h{c}', f'(1.0 - {c}/65535.0::DOUBLE - k)*sh', a) for c, a in _ANGLES.items())}, {_ink('hk', 'k', 45.0)} SELECT hk.image_id, hk.y, hk.x, {', '.join(f'CAST(floor((1 - h{c}.v)*(1 - hk.v)*65535 + 0.5) AS INT) AS {c}' for c in RGB)} FROM hk JOIN hr USING (image_id, y, x) JOIN hg USING (image_id, y, x) JOIN hb USING (image_id, y, x)",
)


def _speckle_sql() -> str:
    """Thirty-two passes over the image and its repeated edge, ten wide, in reading order."""
    head = f"WITH {PX}, lg AS (SELECT image_id, y, x, 0 AS c, r AS v FROM px UNION ALL SELECT image_id, y, x, 1, g FROM px UNION ALL SELECT image_id, y, x, 2, b FROM px), w0 AS (SELECT image_id, c, i, v FROM lg JOIN (SELECT unnest(range(100)) AS i) ON y = least(greatest(i // 10 - 1, 0), 7) AND x = least(greatest(i % 10 - 1, 0), 7))"
    n = 0
    for dy, dx in ((0, 1), (1, 0), (1, 1), (-1, 1)):
        o = 10 * dy + dx
        for way, up in ((o, 1), (o, 1), (-o, 1), (-o, 1), (-o, 0), (-o, 0), (o, 0), (o, 0)):
            q = f"lead(v, {way}) OVER (PARTITION BY image_id, c ORDER BY i)" if way > 0 else f"lag(v, {-way}) OVER (PARTITION BY image_id, c ORDER BY i)"
            new = "CASE WHEN q >= v + 514 THEN least(v + 257, 65535) ELSE v END" if up else "CASE WHEN q <= v - 514 THEN greatest(v - 257, 0) ELSE v END"
            head += f", w{n + 1} AS MATERIALIZED (SELECT image_id, c, i, CASE WHEN i BETWEEN 11 AND 88 THEN {new} ELSE v END AS v FROM (SELECT *, {q} AS q FROM w{n}))"
            n += 1
    return f"{head} SELECT image_id, CAST(i // 10 - 1 AS INT) AS y, CAST(i % 10 - 1 AS INT) AS x, {', '.join(f'max(CASE WHEN c = {k} THEN v END) AS {c}' for k, c in enumerate(RGB))} FROM w{n} WHERE i // 10 BETWEEN 1 AND 8 AND i % 10 BETWEEN 1 AND 8 GROUP BY 1, 2, 3"


register("despeckle", lambda s, d: _pixels(creative.despeckle(_images(s, d))), _speckle_sql())
#: Points of the sparse colour queries: x, y, r, g, b.
_POINTS = [(1.0, 1.0, 65535.0, 0.0, 0.0), (6.0, 2.0, 0.0, 65535.0, 30000.0), (3.5, 7.0, 1000.0, 2000.0, 65535.0)]
_SPARSE = f"{PX}, pt AS (SELECT * FROM (VALUES {', '.join(f'({k}, ' + ', '.join(f'{v}::DOUBLE' for v in p) + ')' for k, p in enumerate(_POINTS))}) v(k, cx, cy, cr, cg, cb)), d AS (SELECT image_id, y, x, k, cr, cg, cb, (x-cx)*(x-cx) + (y-cy)*(y-cy) AS e, abs(x-cx) + abs(y-cy) AS m FROM px, pt)"
for _method, _far in (("voronoi", "e"), ("manhattan", "m")):
    register(f"sparse_{_method}", lambda s, d, m=_method: _pixels(creative.sparse_color(_images(s, d), m, _POINTS)), f"WITH {_SPARSE}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY {_far}, k) AS n FROM d) SELECT image_id, y, x, CAST(cr AS INT) AS r, CAST(cg AS INT) AS g, CAST(cb AS INT) AS b FROM o WHERE n = 1")
for _method, _power in (("shepards", "1.0"), ("inverse", "0.5")):
    register(f"sparse_{_method}", lambda s, d, m=_method: _pixels(creative.sparse_color(_images(s, d), m, _POINTS)), f"WITH {_SPARSE}, w AS (SELECT *, 1/greatest(pow(e, {_power}), 1) AS w FROM d) SELECT image_id, y, x, {', '.join(f'CAST(floor(sum(c{c}*w)/sum(w) + 0.5) AS INT) AS {c}' for c in RGB)} FROM w GROUP BY 1, 2, 3")
_PUSH = "exp(-((x-4)*(x-4) + (y-3)*(y-3))/2.0::DOUBLE)*0.8"
_COME = f"{PX}, s AS (SELECT image_id, y, x, r, g, b, (x-4)*(x-4) + (y-3)*(y-3) < 9 AS ok, x - 2.0::DOUBLE*({_PUSH}) AS sx, y + 1.0::DOUBLE*({_PUSH}) AS sy FROM px), t AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0 FROM s)"
register(
    "liquify",
    lambda s, d: _pixels(creative.liquify(_images(s, d), [(4, 3, 2.0, -1.0)], 3, 0.8)),
    f"WITH {_COME}, v AS (SELECT t.image_id, t.y, t.x, {', '.join(f'CAST(floor(round(sum(q.{c}*(CASE WHEN dx = 1 THEN sx - x0 ELSE 1 - sx + x0 END)*(CASE WHEN dy = 1 THEN sy - y0 ELSE 1 - sy + y0 END)), 6)) AS INT) AS {c}' for c in RGB)} FROM t, (SELECT unnest([0, 1]) AS dx) a, (SELECT unnest([0, 1]) AS dy) b JOIN px q ON q.image_id = t.image_id AND q.x = CAST(least(greatest(x0 + dx, 0), 7) AS INT) AND q.y = CAST(least(greatest(y0 + dy, 0), 7) AS INT) WHERE ok GROUP BY 1, 2, 3) SELECT s.image_id, s.y, s.x, {', '.join(f'coalesce(v.{c}, s.{c}) AS {c}' for c in RGB)} FROM s LEFT JOIN v USING (image_id, y, x)",
)
_LINES = ", ".join(f"({k}, {a!r}::DOUBLE)" for k, a in enumerate(creative.angles()))
register(
    "skew",
    lambda s, d: creative.skews(_images(s, d), 0.45),
    f"WITH {PX}, f AS (SELECT image_id, y, x FROM px WHERE (r + g + b)/3.0::DOUBLE < {int(0.45 * M)}), a AS (SELECT * FROM (VALUES {_LINES}) v(k, a)), b AS (SELECT image_id, k, a, CAST(trunc((x-4.0)*sin(a*pi()/180.0) + (y-4.0)*cos(a*pi()/180.0) + 8) AS INT) AS bin, count(*) AS n FROM f, a GROUP BY 1, 2, 3, 4), "
    "s AS (SELECT image_id, k, a, sum(n*n) AS s, sum(n) AS t FROM b GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, k) AS rn FROM s) SELECT i.image_id, CASE WHEN s/16.0::DOUBLE - (t/16.0::DOUBLE)*(t/16.0::DOUBLE) > 1e-12 THEN a ELSE 0.0::DOUBLE END AS degrees FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN o ON o.image_id = i.image_id AND rn = 1",
)
register("deskew", lambda s, d: _pixels(creative.deskew(_images(s, d), 0.45)))
register("shear", lambda s, d: _pixels(creative.shear(_images(s, d), 20.0, 10.0)))
register("polaroid", lambda s, d: _pixels(creative.polaroid(_images(s, d), 2, (65535, 0, 257))), f"WITH {PX}, c AS (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(16)) AS y), (SELECT unnest(range(12)) AS x)) SELECT c.image_id, c.y, c.x, coalesce(px.r, 65535) AS r, coalesce(px.g, 0) AS g, coalesce(px.b, 257) AS b FROM c LEFT JOIN px ON px.image_id = c.image_id AND px.y = c.y - 2 AND px.x = c.x - 2")
