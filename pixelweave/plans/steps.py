"""Textual and fluent pipelines of steps, planned before any DataFrame is built.

Planning moves a crop before a neighbourhood step by growing it by the step's reach (the halo), so that pixels outside are
neither read nor blurred; consecutive crops become one. Steps of one pixel each collapse into one projection by themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import colorspaces, point
from ..operators import geometry, histogram, kernels, neighbourhood
from ..sources.rasters import to_long, to_wide


@dataclass
class Step:
    name: str
    args: list[float] = field(default_factory=list)


def _wide(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda d: to_wide(f(to_long(d)))


#: Step → (least and most arguments, how it is applied given its arguments).
STEPS: dict[str, tuple[int, int, Callable]] = {
    "crop": (4, 4, lambda x, y, w, h: lambda d: geometry.crop(d, int(x), int(y), int(w), int(h))),
    "flip": (0, 0, lambda: geometry.flip),
    "flop": (0, 0, lambda: geometry.flop),
    "rotate": (1, 1, lambda a: lambda d: geometry.rotate(d, int(a))),
    "trim": (0, 1, lambda fuzz=0.0: lambda d: geometry.trim(d, fuzz * 65535)),
    "shave": (2, 2, lambda x, y: lambda d: geometry.shave(d, int(x), int(y))),
    "transpose": (0, 0, lambda: geometry.transpose),
    "transverse": (0, 0, lambda: geometry.transverse),
    "seamcarve": (2, 2, lambda w, h: lambda d: kernels.seam_carve(d, int(w), int(h))),
    "blur": (0, 1, lambda s=1.0: lambda d: neighbourhood.gaussian_blur(d, s)),
    "boxblur": (0, 1, lambda r=1: lambda d: neighbourhood.box_blur(d, int(r))),
    "sharpen": (0, 1, lambda s=1.0: lambda d: neighbourhood.sharpen(d, s)),
    "edgedetect": (0, 0, lambda: neighbourhood.edge_detect),
    "emboss": (0, 0, lambda: neighbourhood.emboss),
    "median": (0, 1, lambda r=1: lambda d: neighbourhood.median_filter(d, int(r))),
    "brightness": (1, 1, lambda f: lambda d: point.brightness(d, f)),
    "contrast": (1, 1, lambda f: lambda d: point.contrast(d, f)),
    "gamma": (1, 1, lambda f: lambda d: point.gamma(d, f)),
    "grayscale": (0, 0, lambda: point.grayscale),
    "invert": (0, 0, lambda: point.invert),
    "threshold": (0, 1, lambda t=0.5: lambda d: point.mean_threshold(d, t)),
    "posterize": (0, 1, lambda n=4: lambda d: point.posterize(d, int(n))),
    "saturate": (1, 1, lambda f: lambda d: point.saturate(d, f)),
    "equalize": (0, 0, lambda: _wide(histogram.equalize)),
    "normalize": (0, 0, lambda: histogram.normalize),
    "autolevel": (0, 0, lambda: histogram.auto_level),
    "autogamma": (0, 0, lambda: histogram.auto_gamma),
    "whitebalance": (0, 0, lambda: histogram.white_balance),
    "sepia": (0, 1, lambda t=0.8: lambda d: point.sepia(d, t)),
    "solarize": (0, 1, lambda t=0.5: lambda d: point.solarize(d, t)),
    "modulate": (2, 3, lambda b, s, h=100: lambda d: colorspaces.modulate(d, b, s, h)),
}
ALIASES = {"gaussianblur": "blur", "sepiatone": "sepia"}
#: Steps of one pixel each: a crop passes them unchanged.
PIXEL = {"brightness", "contrast", "gamma", "grayscale", "invert", "threshold", "posterize", "saturate", "sepia", "solarize", "modulate"}
#: Steps that read pixels up to a distance: a crop passes them grown by it.
REACH: dict[str, Callable[[list[float]], int]] = {
    "blur": lambda a: len(neighbourhood.gaussian_weights(a[0] if a else 1.0)) // 2,
    "sharpen": lambda a: len(neighbourhood.gaussian_weights(a[0] if a else 1.0)) // 2,
    "boxblur": lambda a: int(a[0]) if a else 1,
    "median": lambda a: int(a[0]) if a else 1,
    "edgedetect": lambda a: 1,
    "emboss": lambda a: 1,
}


def parse(text: str) -> Step:
    parts = text.split()
    if not parts:
        raise ValueError("an empty step")
    name = ALIASES.get(parts[0].lower(), parts[0].lower())
    if name not in STEPS:
        raise ValueError(f"unknown step {name!r}; one of {', '.join(sorted([*STEPS, *ALIASES]))}")
    least, most, _ = STEPS[name]
    args = [float(x) for x in parts[1:]]
    if not least <= len(args) <= most:
        raise ValueError(f"{name} takes {least} to {most} numbers")
    return Step(name, args)


def plan(steps: list[Step]) -> list[Step]:
    """Crops as early as they can stand. A crop that passes a step with reach leaves an exact crop behind it."""
    out: list[Step] = []
    for step in steps:
        if step.name != "crop":
            out.append(step)
            continue
        x, y, w, h = step.args
        at = len(out)
        while at and (out[at - 1].name in PIXEL or out[at - 1].name in REACH):
            before = out[at - 1]
            if before.name in REACH:
                r = REACH[before.name](before.args)
                # the grown crop keeps the image's own edges, where neighbours are repeated
                x0, y0 = max(0.0, x - r), max(0.0, y - r)
                out.insert(at, Step("crop", [x - x0, y - y0, w, h]))
                w, h = w + (x - x0) + r, h + (y - y0) + r
                x, y = x0, y0
            at -= 1
        out.insert(at, Step("crop", [x, y, w, h]))
    merged: list[Step] = []
    for step in out:
        if merged and step.name == merged[-1].name == "crop":
            a, b = merged[-1].args, step.args
            merged[-1] = Step("crop", [a[0] + b[0], a[1] + b[1], min(b[2], a[2] - b[0]), min(b[3], a[3] - b[1])])
        else:
            merged.append(step)
    return merged


def execute(df: DataFrame, steps: list[str], optimize: bool = True) -> DataFrame:
    parsed = [parse(s) for s in steps]
    for step in plan(parsed) if optimize else parsed:
        df = df.transform(STEPS[step.name][2](*step.args))
    return df


class Pipeline:
    """Fluent form: every step name is a method; ``apply`` takes any DataFrame function."""

    def __init__(self, df: DataFrame):
        self._df, self._steps = df, []

    def __getattr__(self, name: str):
        if name.startswith("_") or ALIASES.get(name, name) not in STEPS:
            raise AttributeError(name)

        def add(*args: float) -> Pipeline:
            self._steps.append(parse(" ".join([name, *map(str, args)])))
            return self

        return add

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        self._df, self._steps = f(self.to_frame()), []
        return self

    def inspect(self, f: Callable[[DataFrame], object]) -> Pipeline:
        f(self.to_frame())
        return self

    def to_frame(self) -> DataFrame:
        df = self._df
        for step in plan(self._steps):
            df = df.transform(STEPS[step.name][2](*step.args))
        return df
