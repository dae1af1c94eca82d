"""Per-pixel expressions compiled to Columns.

Loosest to tightest: ``;`` (the last value counts), ``c ? a : b``, ``||``, ``&&``, comparisons, ``+ -``, ``* / %``, ``^`` (to the
right), unary ``- + !`` (tighter than ``^``), ``.channel``. Truth is 1.0 or 0.0; division and remainder by zero give 0.
Images are u (or s, u[0]) and v (u[1]): tables joined by place. Results are clamped to 0..1 and stored rounded.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colorspaces import to_hsl
from ..functions.quantum import M, from_unit, luma
from ..operators.geometry import sizes

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(&&|\|\||<=|>=|==|!=|[-+*/%^!?:;,.()\[\]<>]))")
CONSTANTS = {"pi": math.pi, "e": math.e, "phi": (1 + math.sqrt(5)) / 2, "epsilon": 1e-15, "quantumrange": float(M), "quantumscale": 1.0 / M, "maxrgb": float(M), "opaque": 1.0, "transparent": 0.0}
CHANNELS = {"r": "r", "red": "r", "g": "g", "green": "g", "b": "b", "blue": "b", "a": "a", "alpha": "a", "o": "a", "opacity": "a", "hue": "hue", "saturation": "saturation", "lightness": "lightness", "intensity": "intensity"}


class ExpressionError(ValueError):
    pass


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _log(x: Column, base: float) -> Column:
    positive = x > 0
    return F.when(x == 0, float("-inf")).when(positive, F.log(F.when(positive, x).otherwise(1.0)) / math.log(base)).otherwise(float("nan"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def _mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def _trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


FUNCTIONS = {
    **{n: (1, getattr(F, n)) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "abs", "exp", "sqrt")},
    "ceil": (1, lambda x: F.ceil(x).cast("double")),
    "floor": (1, lambda x: F.floor(x).cast("double")),
    "sign": (1, F.signum),
    "round": (1, lambda x: F.bround(x, 0)),
    "trunc": (1, _trunc),
    "int": (1, _trunc),
    "ln": (1, lambda x: _log(x, math.e)),
    "log": (1, lambda x: _log(x, 10)),
    "log2": (1, lambda x: _log(x, 2)),
    "logtwo": (1, lambda x: _log(x, 2)),
    "not": (1, lambda x: _flag(x == 0)),
    "isnan": (1, lambda x: _flag(F.isnan(x))),
    "sinc": (1, lambda x: F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / F.when(x == 0, 1.0).otherwise(x * math.pi))),
    "gauss": (1, lambda x: F.exp(x * x / -2)),
    "atan2": (2, F.atan2),
    "pow": (2, F.pow),
    "hypot": (2, F.hypot),
    "min": (2, F.least),
    "max": (2, F.greatest),
    "mod": (2, _mod),
    "clamp": (3, lambda v, low, high: F.least(F.greatest(v, low), high)),
    "if": (3, lambda c, a, b: F.when(c != 0, a).otherwise(b)),
}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r} at {at}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("mark", m[3]))
        at = m.end()
    return [*out, ("end", "")]


class Compiler:
    """Recursive descent straight to Columns; ``channel`` is the one being computed."""

    def __init__(self, text: str, images: int = 1):
        self.tokens, self.at, self.images, self.places = tokenize(text), 0, images, []

    def compile(self) -> Column:
        out = self.sequence()
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def take(self, *marks: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind == "mark" and value in marks:
            self.at += 1
            return value
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise ExpressionError(f"{mark!r} expected before {self.tokens[self.at][1]!r}")

    def sequence(self) -> Column:
        out = self.choice()
        while self.take(";"):
            if self.tokens[self.at][0] == "end":
                break
            out = self.choice()
        return out

    def choice(self) -> Column:
        c = self.either()
        if self.take("?"):
            a = self.choice()
            self.need(":")
            return F.when(c != 0, a).otherwise(self.choice())
        return c

    def _level(self, below, marks: dict) -> Column:
        out = below()
        while (mark := self.take(*marks)) is not None:
            out = marks[mark](out, below())
        return out

    def either(self) -> Column:
        return self._level(self.both, {"||": lambda a, b: _flag((a != 0) | (b != 0))})

    def both(self) -> Column:
        return self._level(self.comparison, {"&&": lambda a, b: _flag((a != 0) & (b != 0))})

    def comparison(self) -> Column:
        return self._level(self.sum, {"<": lambda a, b: _flag(a < b), ">": lambda a, b: _flag(a > b), "<=": lambda a, b: _flag(a <= b), ">=": lambda a, b: _flag(a >= b), "==": lambda a, b: _flag(a == b), "!=": lambda a, b: _flag(a != b)})

    def sum(self) -> Column:
        return self._level(self.product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def product(self) -> Column:
        return self._level(self.power, {"*": lambda a, b: a * b, "/": _div, "%": _mod})

    def power(self) -> Column:
        base = self.unary()
        return F.pow(base, self.power()) if self.take("^") else base

    def unary(self) -> Column:
        mark = self.take("-", "+", "!")
        if mark:
            x = self.unary()
            return -x if mark == "-" else x if mark == "+" else _flag(x == 0)
        return self.primary()

    def channel(self, image: int) -> Column:
        name = "intensity"
        if self.take("."):
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind != "name" or value.lower() not in CHANNELS:
                raise ExpressionError(f"unknown channel {value!r}")
            name = CHANNELS[value.lower()]
        return self.value(image, name)

    def value(self, image: int, name: str) -> Column:
        if not 0 <= image < self.images:
            return F.lit(0.0)
        p = "" if image == 0 else f"v{image}_"
        unit = lambda c: F.col(f"{p}{c}") / float(M)
        if name in "rgb":
            return unit(name)
        if name == "a":
            return F.coalesce(unit("a"), F.lit(1.0))
        if name == "intensity":
            return luma("linear", unit("r"), unit("g"), unit("b"))
        return dict(zip(("hue", "saturation", "lightness"), to_hsl(unit("r"), unit("g"), unit("b")), strict=True))[name]

    def primary(self) -> Column:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(value))
        if kind == "mark" and value == "(":
            out = self.sequence()
            self.need(")")
            return out
        if kind != "name":
            raise ExpressionError(f"unexpected {value!r}" if value else "the expression ends too early")
        name = value.lower()
        following = self.tokens[self.at]
        if name in FUNCTIONS and following == ("mark", "("):
            n, f = FUNCTIONS[name]
            self.need("(")
            args = [self.choice()]
            while self.take(","):
                args.append(self.choice())
            self.need(")")
            if len(args) != n:
                raise ExpressionError(f"{name} takes {n} arguments")
            return f(*args)
        if value in ("u", "s", "v"):
            image = 1 if value == "v" else 0
            if value == "u" and self.take("["):
                kind, number = self.tokens[self.at]
                if kind != "number":
                    raise ExpressionError("u[...] takes a number")
                self.at += 1
                self.need("]")
                image = int(float(number))
            return self.channel(image)
        variables = {"i": "x", "x": "x", "j": "y", "y": "y", "w": "fx_w", "width": "fx_w", "h": "fx_h", "height": "fx_h"}
        if name in variables:
            return F.col(variables[name]).cast("double")
        if name == "n":
            return F.lit(float(self.images))
        if name in CHANNELS and name not in CONSTANTS:
            return self.value(0, CHANNELS[name])
        if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        raise ExpressionError(f"unknown name {value!r}")


def apply(images: list[DataFrame] | DataFrame, red: str, green: str | None = None, blue: str | None = None, alpha: str | None = None) -> DataFrame:
    """``red`` alone sets all three colours of image 0; else one expression a channel. Other images join by place."""
    images = images if isinstance(images, list) else [images]
    key = ["image_id", "y", "x"]
    rows = reduce(lambda d, k: d.join(images[k].select(*key, *[F.col(c).alias(f"v{k}_{c}") for c in "rgba"]), key, "left"), range(1, len(images)), images[0])
    texts = [red, green or red, blue or red, *([alpha] if alpha else [])]
    names = {t for text in texts for k, t in tokenize(text) if k == "name"}
    if names & {"w", "h", "width", "height"}:
        rows = rows.join(sizes(images[0]).select("image_id", F.col("w").alias("fx_w"), F.col("h").alias("fx_h")), "image_id")
    out = {c: from_unit(Compiler(text, len(images)).compile()) for c, text in zip("rgba", texts, strict=False)}
    return rows.select(*key, *[out.get(c, F.col(c)).alias(c) for c in "rgba"])
