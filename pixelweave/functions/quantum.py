"""16-bit channel values: the four rounding rules, depth changes and luma weights, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest channel value.
M = 65535

#: Luma weights by name.
LUMA = {"709": (0.2126, 0.7152, 0.0722), "601": (0.299, 0.587, 0.114), "linear": (0.212656, 0.715158, 0.072186)}


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(v: Column, low: float = 0.0, high: float = M) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def q16(v: Column) -> Column:
    """Clamp, then round half up; NaN is 0."""
    return F.when(F.isnan(v), 0).otherwise(F.floor(clamp(v) + 0.5)).cast("int")


def t16(v: Column) -> Column:
    """Clamp, then truncate."""
    return F.floor(clamp(v)).cast("int")


def unit(c: str | Column) -> Column:
    """Channel value as 0..1."""
    return col(c) / float(M)


def from_unit(v: Column) -> Column:
    return q16(v * float(M))


def to_byte(c: str | Column) -> Column:
    """The exact 16 to 8 bit map."""
    v = col(c) + 128
    return F.shiftright(v - F.shiftright(v, 8), 8)


def from_byte(c: str | Column) -> Column:
    return col(c) * 257


def to_depth(c: str | Column, bits: int) -> Column:
    return F.floor(col(c) * float((1 << bits) - 1) / M + 0.5).cast("int")


def from_depth(c: str | Column, bits: int) -> Column:
    return F.floor(col(c) * float(M) / ((1 << bits) - 1) + 0.5).cast("int")


def luma(kind: str = "709", r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    """Weighted sum of the channels; those of "601" are whole thousandths, which whole values get exactly; "601 double" sums them in doubles, from left to right."""
    w = LUMA[kind.removesuffix(" double")]
    if kind == "601":
        return (col(r) * 299 + col(g) * 587 + col(b) * 114) / 1000.0
    return col(r) * w[0] + col(g) * w[1] + col(b) * w[2]
