"""Palettes: of one image by cutting its colours at medians, of a whole table by an octree over partial sums, and mapping to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import follow
from . import frames
from .frames import _bytes

#: Levels of the octree, and cells of its finest one: the most rows that partial sums have, at any number of pixels.
DEPTH = 5
CELLS = 1 << 3 * DEPTH
#: Cells a side of the grid that finds nearest colours.
GRID = 16


def median_cut(colors: np.ndarray, most: int) -> np.ndarray:
    """(n, 3) bytes: the box of most volume is cut at the median of its longest side, until there are enough; means, rounded down.

    ``colors``: (m, 3) bytes, a row a pixel. Colours equal on the side that is cut keep the order of the whole colour.
    """
    v = colors[np.lexsort(colors.T[::-1])].astype(np.int64)
    boxes = [v]
    while len(boxes) < most:
        volumes = [int((np.ptp(b, axis=0) + 1).prod()) if len(b) > 1 else 0 for b in boxes]
        k = int(np.argmax(volumes))
        if volumes[k] < 2:  # one colour in each box
            break
        box = boxes[k]
        box = box[np.argsort(box[:, int(np.argmax(np.ptp(box, axis=0)))], kind="stable")]
        boxes[k] = box[: len(box) // 2]
        boxes.append(box[len(box) // 2 :])
    return np.array([b.sum(0) // len(b) for b in boxes], np.uint8)


class Nearest:
    """The nearest colour of a palette, the first of equally near ones, by a grid of the colour cube.

    A cell lists the colours that can be nearest to some colour in it: those not farther from the cell at best than another
    is at worst. A lookup compares only these.
    """

    def __init__(self, palette: np.ndarray):
        self.palette = palette.astype(np.int64)
        size = 256 // GRID
        low = np.arange(GRID)[:, None] * size
        value = self.palette.T[:, None]  # channel, 1, colour
        below, above = np.maximum(low - value, 0), np.maximum(value - (low + size - 1), 0)
        nearest, farthest = np.maximum(below, above) ** 2, np.maximum(abs(low - value), abs(low + size - 1 - value)) ** 2
        sums = lambda d: d[0][:, None, None] + d[1][None, :, None] + d[2][None, None]
        least, most = sums(nearest).reshape(GRID**3, -1), sums(farthest).reshape(GRID**3, -1)
        can = least <= most.min(1, keepdims=True)
        width = int(can.sum(1).max())
        self.lists = np.argsort(~can, axis=1, kind="stable")[:, :width]
        self.counts = can.sum(1)

    def __call__(self, colors: np.ndarray) -> np.ndarray:
        """Places in the palette of (..., 3) bytes."""
        v = colors.reshape(-1, 3).astype(np.int64)
        cell = (v // (256 // GRID)) @ np.array([GRID * GRID, GRID, 1])
        out = np.empty(len(v), np.int64)
        for at in range(0, len(v), 1 << 16):
            part, c = v[at : at + (1 << 16)], cell[at : at + (1 << 16)]
            lists = self.lists[c]
            d = ((self.palette[lists] - part[:, None]) ** 2).sum(2)
            d[np.arange(lists.shape[1]) >= self.counts[c][:, None]] = 1 << 40
            out[at : at + (1 << 16)] = lists[np.arange(len(part)), d.argmin(1)]
        return out.reshape(colors.shape[:-1])


def mapped(p: np.ndarray, palette: np.ndarray, dither: bool = False) -> np.ndarray:
    """Every pixel as the nearest of the palette's colours; with ``dither`` what is lost goes to the neighbours that follow (7, 3, 5, 1 of 16).

    Pixels (y, x) of one x + 2 y depend only on smaller ones, so such a diagonal is one step.
    """
    find = Nearest(palette)
    v = _bytes(p[..., :3])
    if not dither:
        color = palette[find(v)]
    else:
        h, w = v.shape[:2]
        rest = np.zeros((h + 1, w + 2, 3), np.float32)
        color = np.zeros((h, w, 3), np.uint8)
        for t in range(w + 2 * h - 2):
            y = np.arange(max(0, (t - w + 2) // 2), min(h - 1, t // 2) + 1)
            x = t - 2 * y
            value = v[y, x] + rest[y, x + 1]
            color[y, x] = palette[find(np.clip(value + np.float32(0.5), 0, 255).astype(np.uint8))]
            lost = value - color[y, x]
            for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                rest[y + dy, x + 1 + dx] += lost * np.float32(share / 16)
    return np.concatenate([color.astype(np.int64) * 257, p[..., 3:]], 2)


def quantize(images: DataFrame, most: int, dither: bool = True) -> DataFrame:
    """Each image in at most 2 to 256 colours of its own."""
    most = min(max(most, 2), 256)
    return frames.apply(images, lambda p: mapped(p, median_cut(_bytes(p[..., :3]).reshape(-1, 3), most), dither))


def palettes(images: DataFrame, most: int) -> DataFrame:
    """image_id, k, r, g, b (bytes) of each image's own colours, in the order of the cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[batch.column(c) for c in frames.COLUMNS], strict=True):
                found = median_cut(_bytes(frames._array(row)[..., :3]).reshape(-1, 3), most).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row[0].as_py()] * len(found), pa.int64()), pa.array(np.arange(len(found), dtype=np.int32)), *[pa.array(found[:, c]) for c in range(3)]], names=["image_id", "k", "r", "g", "b"])

    return follow(images, frames.COLUMNS, run, "image_id long, k int, r int, g int, b int")


# --- one palette for a table --------------------------------------------------------------------------------------------------------


def _cells(v: np.ndarray) -> np.ndarray:
    """Octree cells of (n, 3) bytes: the top bits of the channels interleaved, coarsest first."""
    out = np.zeros(len(v), np.int64)
    for bit in range(7, 7 - DEPTH, -1):
        for c in range(3):
            out = out << 1 | (v[:, c].astype(np.int64) >> bit & 1)
    return out


def cell_sums(images: DataFrame) -> DataFrame:
    """cell, n and sums of r, g, b (bytes) of all pixels of all images: summed by task, then by cell; at most 32,768 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, CELLS), np.int64)
        for batch in batches:
            for row in zip(*[batch.column(c) for c in frames.COLUMNS], strict=True):
                p = _bytes(frames._array(row)[..., :3]).reshape(-1, 3)
                for at in range(0, len(p), 1 << 20):
                    v = p[at : at + (1 << 20)]
                    cell = _cells(v)
                    total[0] += np.bincount(cell, minlength=CELLS)
                    for c in range(3):
                        total[1 + c] += np.bincount(cell, v[:, c], CELLS).astype(np.int64)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(t[some]) for t in total]], names=["cell", "n", "r", "g", "b"])

    parts = follow(images, frames.COLUMNS, run, "cell int, n long, r long, g long, b long")
    return parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "r", "g", "b")])


def octree(cells: np.ndarray, sums: np.ndarray, most: int) -> np.ndarray:
    """(k, 3) bytes from cells and their (n, r, g, b): leaves of the fewest pixels are merged into their parent, deepest first, until at most ``most`` remain.

    Of one depth the parent of fewest pixels goes first, then the first. Colours are the means of the leaves, in order of cell.
    """
    leaves = {(DEPTH, int(c)): s.astype(np.int64) for c, s in zip(cells, sums, strict=True)}
    for depth in range(DEPTH, 0, -1):
        parents: dict[int, list[tuple[int, int]]] = {}
        for d, c in leaves:
            if d == depth:
                parents.setdefault(c >> 3, []).append((d, c))
        for parent in sorted(parents, key=lambda q: (sum(int(leaves[k][0]) for k in parents[q]), q)):
            if len(leaves) <= most:
                break
            leaves[depth - 1, parent] = sum(leaves.pop(k) for k in parents[parent])
        if len(leaves) <= most:
            break
    order = sorted(leaves, key=lambda k: k[1] << 3 * (DEPTH - k[0]))
    return np.array([leaves[k][1:] / leaves[k][0] for k in order]).round().astype(np.uint8).reshape(-1, 3)


def shared_palette(images: DataFrame, most: int = 256) -> np.ndarray:
    """One palette for all images: the driver gets at most 32,768 rows of sums, whatever the table holds."""
    rows = cell_sums(images).orderBy("cell").toPandas()
    return octree(rows["cell"].to_numpy(), rows[["n", "r", "g", "b"]].to_numpy(), most)


def remap(images: DataFrame, palette: np.ndarray, dither: bool = False) -> DataFrame:
    """All images in the colours of one palette of at most 256."""
    return frames.apply(images, lambda p: mapped(p, palette, dither))
