"""Blending one image over another: 29 modes as Column expressions over one positional left join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantum import M, from_unit, luma


def _where(c, a, b):
    return F.when(c, a).otherwise(b)


def _dodge(b, o):
    return F.when(b <= 0, 0.0).when(o >= 1, 1.0).otherwise(F.least(F.lit(1.0), b / _where(o < 1, 1 - o, F.lit(1.0))))


def _burn(b, o):
    return F.when(b >= 1, 1.0).when(o <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - b) / _where(o > 0, o, F.lit(1.0))))


def _soft(b, o):
    d = _where(b <= 0.25, ((b * 16 - 12) * b + 4) * b, F.sqrt(b))
    return _where(o <= 0.5, b - (1 - o * 2) * b * (1 - b), b + (o * 2 - 1) * (d - b))


def _hard(b, o):
    return _where(o < 0.5, b * o * 2, 1 - (1 - b) * (1 - o) * 2)


#: Modes whose result is mixed with the base by the overlay's alpha.
MIXED: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda b, o: b * o,
    "screen": lambda b, o: 1 - (1 - b) * (1 - o),
    "overlay": lambda b, o: _hard(o, b),
    "hardlight": _hard,
    "softlight": _soft,
    "colordodge": _dodge,
    "colorburn": _burn,
    "linearlight": lambda b, o: F.least(F.greatest(b + o * 2 - 1, F.lit(0.0)), F.lit(1.0)),
    "vividlight": lambda b, o: _where(o <= 0.5, _burn(b, o * 2), _dodge(b, o * 2 - 1)),
    "pinlight": lambda b, o: _where(o < 0.5, F.least(b, o * 2), F.greatest(b, o * 2 - 1)),
    "hardmix": lambda b, o: _where(b + o >= 1, F.lit(1.0), F.lit(0.0)),
    "darken": lambda b, o: F.least(b, o),
    "lighten": lambda b, o: F.greatest(b, o),
    "difference": lambda b, o: F.abs(b - o),
    "exclusion": lambda b, o: b + o - b * o * 2,
    "add": lambda b, o: F.least(F.lit(1.0), b + o),
    "subtract": lambda b, o: F.greatest(F.lit(0.0), b - o),
}
MODES = sorted([*MIXED, "over", "plus", "minus", "modulusadd", "modulussubtract", "replace", "atop", "in", "out", "xor", "bumpmap", "dissolve"])


def _blend(mode: str, b: Column, o: Column, ab: Column, ao: Column, bump: Column) -> Column:
    if mode in MIXED:
        return b * (1 - ao) + MIXED[mode](b, o) * ao
    total = ao + ab * (1 - ao)
    if mode == "over":
        return F.when(total > 0, (o * ao + b * ab * (1 - ao)) / _where(total > 0, total, F.lit(1.0))).otherwise(0.0)
    if mode == "plus":
        return F.least(F.lit(1.0), b * ab + o * ao)
    if mode == "minus":
        return F.greatest(F.lit(0.0), b * ab - o * ao)
    if mode == "modulusadd":
        return (b + o) % 1.0
    if mode == "modulussubtract":
        return (b - o + 1) % 1.0
    if mode in ("replace", "in", "out"):
        return o
    if mode == "atop":
        return F.when(ab > 0, (o * ao * ab + b * ab * (1 - ao)) / _where(ab > 0, ab, F.lit(1.0))).otherwise(b)
    if mode == "xor":
        both = ao * (1 - ab) + ab * (1 - ao)
        return F.when(both > 0, (o * ao * (1 - ab) + b * ab * (1 - ao)) / _where(both > 0, both, F.lit(1.0))).otherwise(0.0)
    if mode == "bumpmap":
        return b * (1 - ao) + b * bump * ao
    if mode == "dissolve":
        return _where(F.pmod(F.xxhash64("x", "y"), F.lit(M + 1)) / float(M) < ao, o, b)
    raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")


def _alpha(mode: str, ab: Column, ao: Column) -> Column:
    return {"in": ao * ab, "out": ao * (1 - ab), "atop": ab, "xor": ao * (1 - ab) + ab * (1 - ao), "replace": ao, "plus": F.least(F.lit(1.0), ab + ao), "minus": F.greatest(F.lit(0.0), ab - ao)}.get(mode, ao + ab * (1 - ao))


def composite(base: DataFrame, overlay: DataFrame, mode: str = "over", dx: int = 0, dy: int = 0, by_image: bool = True, opacity: float = 1.0) -> DataFrame:
    """``base`` with ``overlay`` laid over it at (dx, dy); pixels outside the overlay stay.

    One left join on the place (and image_id). Without ``by_image`` the single overlay image goes over every base image.
    """
    key = ["image_id", "y", "x"] if by_image else ["y", "x"]
    over = overlay.select(*(["image_id"] if by_image else []), (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), *[F.col(c).alias(f"o{c}") for c in "rgba"])
    rows = base.join(over, key, "left")
    hit = F.col("or").isNotNull()
    ab, ao = F.coalesce("a", F.lit(M)) / float(M), F.coalesce("oa", F.lit(M)) / float(M) * opacity
    bump = luma("601", "or", "og", "ob") / float(M)
    out = {c: F.when(hit, from_unit(_blend(mode, F.col(c) / float(M), F.col(f"o{c}") / float(M), ab, ao, bump))).otherwise(F.col(c)) for c in "rgb"}
    out["a"] = F.when(F.col("a").isNull(), None).when(hit, from_unit(_alpha(mode, ab, ao))).otherwise(F.col("a")).cast("int")
    return rows.withColumns(out).select("image_id", "y", "x", "r", "g", "b", "a")
