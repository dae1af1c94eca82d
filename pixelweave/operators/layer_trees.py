"""Layer trees: documents of layers, groups, masks, clipping and adjustments as one table, flattened in one plan.

``layers`` has a row a layer: doc_id, z (order from the bottom, depth first), depth (0 at the top of the tree), kind
(``layer``, ``group``, ``adjustment``), image_id (of a layer), mask_id (null: none), mode, opacity, visible, clipped, dx, dy,
adjustment (its name). The rows of a group follow it at greater depths, until one at its own depth or less. Order is data:
adding, inserting, removing, moving and merging layers are changes of this table (``moved``, ``removed``, ``inserted``, ``merged``).

``flatten`` joins each row with its image and its mask, by id, and folds the rows of a document in order; a task holds the
canvases of the open groups and one layer. Documents are spread over tasks, the layers of one are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantum import M
from ..sources.batches import follow
from . import frames

LAYERS = "doc_id long, z int, depth int, kind string, image_id long, mask_id long, mode string, opacity double, visible boolean, clipped boolean, dx int, dy int, adjustment string"
COLUMNS = [c.split()[0] for c in LAYERS.split(", ")]


def _safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _dodge(b, o):
    return np.where(b <= 0, 0, np.where(o >= 1, 1, np.minimum(1, b / np.where(o < 1, 1 - o, 1))))


def _burn(b, o):
    return np.where(b >= 1, 1, np.where(o <= 0, 0, 1 - np.minimum(1, (1 - b) / np.where(o > 0, o, 1))))


def _hard(b, o):
    return np.where(o < 0.5, b * o * 2, 1 - (1 - b) * (1 - o) * 2)


def _soft(b, o):
    d = np.where(b <= 0.25, ((b * 16 - 12) * b + 4) * b, np.sqrt(b))
    return np.where(o <= 0.5, b - (1 - o * 2) * b * (1 - b), b + (o * 2 - 1) * (d - b))


#: What a mode makes of base and overlay (0 to 1), before it is mixed with the base by the overlay's alpha.
MIXED: dict[str, Callable] = {
    "multiply": lambda b, o: b * o,
    "screen": lambda b, o: 1 - (1 - b) * (1 - o),
    "overlay": lambda b, o: _hard(o, b),
    "hardlight": _hard,
    "softlight": _soft,
    "colordodge": _dodge,
    "colorburn": _burn,
    "linearlight": lambda b, o: np.clip(b + o * 2 - 1, 0, 1),
    "vividlight": lambda b, o: np.where(o <= 0.5, _burn(b, o * 2), _dodge(b, o * 2 - 1)),
    "pinlight": lambda b, o: np.where(o < 0.5, np.minimum(b, o * 2), np.maximum(b, o * 2 - 1)),
    "hardmix": lambda b, o: np.where(b + o >= 1, 1.0, 0.0),
    "darken": np.minimum,
    "lighten": np.maximum,
    "difference": lambda b, o: np.abs(b - o),
    "exclusion": lambda b, o: b + o - b * o * 2,
    "add": lambda b, o: np.minimum(1, b + o),
    "subtract": lambda b, o: np.maximum(0, b - o),
}
#: Modes of coverage: (colour, alpha) of base, overlay and their alphas.
COVERED: dict[str, Callable] = {
    "over": lambda b, o, ab, ao: (_safe(o * ao + b * ab * (1 - ao), ao + ab * (1 - ao)), ao + ab * (1 - ao)),
    "plus": lambda b, o, ab, ao: (np.minimum(1, b * ab + o * ao), np.minimum(1, ab + ao)),
    "minus": lambda b, o, ab, ao: (np.maximum(0, b * ab - o * ao), np.maximum(0, ab - ao)),
    "replace": lambda b, o, ab, ao: (o, ao),
    "in": lambda b, o, ab, ao: (o, ao * ab),
    "out": lambda b, o, ab, ao: (o, ao * (1 - ab)),
    "atop": lambda b, o, ab, ao: (np.where(ab > 0, _safe(o * ao * ab + b * ab * (1 - ao), ab), b), ab),
    "xor": lambda b, o, ab, ao: (_safe(o * ao * (1 - ab) + b * ab * (1 - ao), ao * (1 - ab) + ab * (1 - ao)), ao * (1 - ab) + ab * (1 - ao)),
}
#: Adjustments of a canvas (r, g, b, a as 16-bit values), by name; more may be added before a query is made.
ADJUSTMENTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "invert": lambda p: np.concatenate([M - p[..., :3], p[..., 3:]], 2),
    "grayscale": lambda p: np.concatenate([np.floor(p[..., :3] @ np.array([0.2126, 0.7152, 0.0722]) + 0.5)[..., None].repeat(3, 2), p[..., 3:]], 2),
    "posterize": lambda p: np.concatenate([np.floor(np.floor(p[..., :3] / M * 3 + 0.5) / 3 * M + 0.5), p[..., 3:]], 2),
}


def blended(base: np.ndarray, over: np.ndarray, mode: str) -> np.ndarray:
    """(h, w, 4) of 16-bit values over others of the same size, rounded."""
    b, o = base[..., :3] / M, over[..., :3] / M
    ab, ao = base[..., 3:] / M, over[..., 3:] / M
    if mode in MIXED:
        color, alpha = b * (1 - ao) + MIXED[mode](b, o) * ao, ao + ab * (1 - ao)
    else:
        color, alpha = COVERED[mode](b, o, ab, ao)
    return np.floor(np.clip(np.concatenate([color, np.broadcast_to(alpha, ab.shape)], 2) * M, 0, M) + 0.5).astype(np.int64)


class Canvas:
    """The canvases of a document: the page and each open group's own."""

    def __init__(self, width: int, height: int):
        self.shape = (height, width)
        self.open: list[tuple[dict | None, np.ndarray]] = [(None, self._empty())]

    def _empty(self) -> np.ndarray:
        return np.zeros((*self.shape, 4), np.int64)

    def _placed(self, p: np.ndarray, dx: int, dy: int, fill: int = 0) -> np.ndarray:
        """``p`` at a place of a canvas of its own, what lies outside cut."""
        out = np.full((*self.shape, p.shape[2]), fill, np.int64)
        window = out[max(dy, 0) : max(dy + p.shape[0], 0), max(dx, 0) : max(dx + p.shape[1], 0)]
        window[...] = p[max(-dy, 0) :, max(-dx, 0) :][: window.shape[0], : window.shape[1]]
        return out

    def _laid(self, row: dict, p: np.ndarray) -> None:
        """A layer or a closed group onto the innermost canvas: opacity and mask, then clipping, then its mode."""
        owner, base = self.open[-1]
        p = p.astype(np.int64)
        if p.shape[2] == 3:
            p = np.concatenate([p, np.full((*p.shape[:2], 1), M)], 2)
        mask = row["mask"]
        if mask is not None or row["opacity"] < 1:
            alpha = p[..., 3] / M * row["opacity"]
            if mask is not None:
                h, w = min(p.shape[0], mask.shape[0]), min(p.shape[1], mask.shape[1])
                alpha[:h, :w] *= mask[:h, :w, 0] / M
            p = np.concatenate([p[..., :3], np.clip((alpha * M).astype(np.int64), 0, M)[..., None]], 2)
        over = self._placed(p, row["dx"], row["dy"])
        if row["clipped"]:
            over[..., 3] = (over[..., 3] / M * (base[..., 3] / M) * M).astype(np.int64)
        where = self._placed(np.ones((*p.shape[:2], 1), np.int64), row["dx"], row["dy"])
        self.open[-1] = (owner, np.where(where > 0, blended(base, over, row["mode"]), base))

    def _adjusted(self, row: dict) -> None:
        owner, base = self.open[-1]
        new, share = ADJUSTMENTS[row["adjustment"]](base), row["opacity"]
        if row["mask"] is not None:
            share = self._placed(row["mask"][..., :1].astype(np.int64), row["dx"], row["dy"]) / M * share
        mixed = new if row["mask"] is None and row["opacity"] >= 1 else base * (1 - share) + new * share
        self.open[-1] = (owner, np.clip(mixed.astype(np.int64), 0, M))

    def close(self, depth: int) -> None:
        """Groups at ``depth`` or deeper end: each becomes a layer of the canvas below."""
        while len(self.open) > 1 and self.open[-1][0]["depth"] >= depth:
            row, p = self.open.pop()
            if row["visible"]:
                self._laid(row, p)

    def add(self, row: dict) -> None:
        self.close(row["depth"])
        if row["kind"] == "group":
            self.open.append((row, self._empty()))
        elif row["visible"] and row["kind"] == "adjustment":
            self._adjusted(row)
        elif row["visible"] and row["image"] is not None:
            self._laid(row, row["image"])

    def result(self) -> np.ndarray:
        self.close(0)
        return self.open[0][1]


def flatten(layers: DataFrame, images: DataFrame, width: int, height: int) -> DataFrame:
    """Image rows of four channels, one for each doc_id: all its layers from the bottom up on a transparent canvas.

    A layer without its image in ``images`` leaves no mark, one without its mask is not masked. Null settings are those of a
    plain layer: over, opaque, visible, not clipped, at 0, 0. Unknown modes and adjustments are errors.
    """
    rows = layers.select(*[c for c in COLUMNS])
    side = lambda name: images.select(F.col("image_id").alias(f"{name}_id"), F.struct(*frames.COLUMNS).alias(name))
    rows = rows.join(side("image").hint("merge"), "image_id", "left").join(side("mask").hint("merge"), "mask_id", "left")
    plain = {"mode": "over", "opacity": 1.0, "visible": True, "clipped": False, "dx": 0, "dy": 0, "depth": 0, "kind": "layer"}

    def array(row) -> np.ndarray | None:
        return frames._array(tuple(row[c] for c in frames.COLUMNS)) if row.is_valid else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, canvas = None, None
        for batch in batches:
            plainly = batch.select(COLUMNS).to_pylist()
            for k, row in enumerate(plainly):
                if canvas is None or row["doc_id"] != doc:
                    if canvas is not None:
                        yield frames._row(doc, canvas.result())
                    doc, canvas = row["doc_id"], Canvas(width, height)
                row = {c: plain.get(c) if v is None else v for c, v in row.items()}
                canvas.add(row | {"image": array(batch.column("image")[k]), "mask": array(batch.column("mask")[k])})
        if canvas is not None:
            yield frames._row(doc, canvas.result())

    dealt = rows.select(*COLUMNS, "image", "mask").repartition("doc_id").sortWithinPartitions("doc_id", "z")
    return follow(dealt, dealt.columns, run, frames.SCHEMA)


# --- changes of the table -----------------------------------------------------------------------------------------------------------


def _renumbered(layers: DataFrame, order: Column) -> DataFrame:
    """z from 0 by ``order`` in each document."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return layers.withColumn("z", at.cast("int")).select(*COLUMNS)


def removed(layers: DataFrame, z: int) -> DataFrame:
    """Without the layer at ``z``, those above one lower."""
    return _renumbered(layers.where(F.col("z") != z), F.col("z"))


def inserted(layers: DataFrame, z: int, new: DataFrame) -> DataFrame:
    """With ``new`` (a row a document) at ``z``, those from there on one higher."""
    both = layers.select(*COLUMNS).withColumn("rank", F.col("z") * 2 + 1).unionByName(new.withColumn("rank", F.lit(2 * z)).select(*COLUMNS, "rank"))
    return _renumbered(both, F.col("rank"))


def moved(layers: DataFrame, before: int, after: int) -> DataFrame:
    """The layer at ``before`` taken out and put in at ``after``."""
    z = F.col("z")
    rest = F.when(z > before, z - 1).otherwise(z)
    return _renumbered(layers, F.when(z == before, 2 * after).otherwise(rest * 2 + F.when(rest >= after, 1).otherwise(-1)))


def merged(layers: DataFrame, images: DataFrame, first: int, count: int, width: int, height: int, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(layers, images) with ``count`` layers from ``first`` on as one, whose image has id ``first_id`` + doc_id."""
    part = F.col("z").between(first, first + count - 1)
    one = flatten(layers.where(part), images, width, height).withColumn("image_id", F.col("image_id") + first_id)
    plain = layers.where(F.col("z") == first).select("doc_id", "z", "depth", F.lit("layer").alias("kind"), (F.col("doc_id") + first_id).alias("image_id"), F.lit(None).cast("long").alias("mask_id"), F.lit("over").alias("mode"), F.lit(1.0).alias("opacity"), F.lit(True).alias("visible"), F.lit(False).alias("clipped"), F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(None).cast("string").alias("adjustment"))
    return _renumbered(layers.where(~part).select(*COLUMNS).unionByName(plain), F.col("z")), images.select(*frames.COLUMNS).unionByName(one)
