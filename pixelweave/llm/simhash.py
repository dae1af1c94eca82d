"""SimHash near-duplicates: 64-bit fingerprints of three-word shingles, linked at three or fewer differing bits, exactly.

Fingerprints are compared once each, whatever the copies of a text. They are laid out in tiles by the population counts of
their four 16-bit quarters. A bit that differs changes one of these counts by one, so two tiles whose counts differ by more
than the radius, all quarters together, hold no link and never meet (23 of 24 pairs of tiles with random bits). All others
are compared completely: a tile is sent to those in reach, where exclusive-or and bit counts of numpy run over tile by tile
matrices of bounded size. A task keeps one tile and the visitors of one step, whatever the number of tiles.

Of the links in a tile and its visitors only a spanning forest is written, at most one edge for each visitor and merger of
classes: a group of near copies costs rows in proportion to its size, and components come out the same.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
QUARTERS, QUARTER_BITS = 4, 16
#: Fingerprints of a tile (cells of equal counts are cut by a hash), and pairs that are compared at once.
TILE, PAIRS = 4096, 1 << 18
#: Bytes of text whose words are in memory together.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = at + PIECE
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of the shingles, repeats included, a piece of the text at a time.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at 0x20 and 0x09 to 0x0D alone.
    """
    words: list[bytes] = []
    some = False
    for piece in _pieces(text):
        words += piece.lower().split()
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            first, last = (ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist()
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
            words, some = words[1 - SHINGLE :], True
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if more than half the shingles' hashes have it; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        for at in range(0, len(hashes), PAIRS // 4):
            part = hashes[at : at + PAIRS // 4]
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.string_buffers(batch.column("text"))
        found = np.fromiter((fingerprint(data[a:b].tobytes()) for a, b in itertools.pairwise(offsets.tolist())), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row, from its whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _cell(fp: Column) -> Column:
    """The four population counts in a byte each; 4 is added, so that no count within reach leaves its byte."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, QUARTER_BITS * k).bitwiseAND(F.lit((1 << QUARTER_BITS) - 1).cast("long"))) for k in range(QUARTERS)]
    return sum((F.shiftleft((c + RADIUS + 1).cast("long"), 8 * k) for k, c in enumerate(counts)), F.lit(0).cast("long"))


def _reach() -> list[int]:
    """Differences of cells within the radius, one of each opposite two."""
    steps = [d for d in itertools.product(range(-RADIUS, RADIUS + 1), repeat=QUARTERS) if sum(map(abs, d)) <= RADIUS and d >= (0,) * QUARTERS]
    return [sum(v << (8 * k) for k, v in enumerate(d)) for d in steps]


class Forest:
    """Classes of fingerprints as they are linked; keeps the edges that merged two classes."""

    def __init__(self, own: np.ndarray):
        self.nodes, self.parent, self.edges = own, np.arange(len(own)), []

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            one, two = self.parent[x], self.parent[y]
            apart = one != two
            if not apart.any():
                return
            high, first = np.unique(np.maximum(one, two)[apart], return_index=True)
            low = np.minimum(one, two)[apart][first]
            self.parent[high] = low
            self.edges.append((self.nodes[high], self.nodes[low]))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def compare(self, a: slice, b: slice) -> None:
        left, right = self.nodes[a], self.nodes[b]
        step = max(1, PAIRS // max(len(right), 1))
        for i in range(0, len(left), step):
            x, y = np.nonzero(np.bitwise_count(left[i : i + step, None] ^ right[None]) <= RADIUS)
            if len(x):
                self.link(x + i + a.start, y + b.start)

    def visit(self, visitors: np.ndarray, own: int) -> None:
        """Compare visitors with the tile (its first ``own`` nodes), then forget them; classes of the tile stay."""
        self.nodes = np.concatenate((self.nodes[:own], visitors))
        self.parent = np.concatenate((self.parent[:own], np.arange(own, len(self.nodes))))
        self.compare(slice(own, len(self.nodes)), slice(0, own))

    def taken(self) -> pa.RecordBatch:
        edges, self.edges = self.edges, []
        a, b = (np.concatenate([e[k] for e in edges] or [np.zeros(0, np.uint64)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of partitions sorted by (cell, part, visitor): each tile comes first, then its visitors."""
    key, forest, own, waiting, held = None, None, 0, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if waiting:
            forest.visit(np.concatenate(waiting), own)
            waiting.clear()
        if forest is not None and forest.edges:
            yield forest.taken()

    for batch in batches:
        cells, parts, visitors, lists = batch.column("cell").to_pylist(), batch.column("part").to_pylist(), batch.column("visitor").to_pylist(), batch.column("fps")
        for i, visitor in enumerate(visitors):
            values = lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            if (cells[i], parts[i]) != key:
                yield from flush()
                key, own, held = (cells[i], parts[i]), len(values), 0
                forest = Forest(values)
                forest.compare(slice(0, own), slice(0, own))
            if visitor:
                waiting.append(values)
                held += len(values)
                if held >= TILE:
                    yield from flush()
                    held = 0
    yield from flush()


def edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links; ``nodes`` is a written table with one row for each fingerprint ``fp``.

    At most 17^4 = 83,521 cells exist at any size of the input, so their counts are broadcast.
    """
    cells = nodes.groupBy(_cell(F.col("fp")).alias("cell")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    cells = common.materialize(cells, "simhash-cells")
    placed = nodes.select("fp", _cell(F.col("fp")).alias("cell")).join(F.broadcast(cells), "cell")
    part = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    tiles = placed.groupBy("cell", part.alias("part")).agg(F.collect_list("fp").alias("fps"))
    tiles = common.materialize(tiles, "simhash-tiles")
    visits = tiles.select(F.col("cell").alias("home"), F.col("part").alias("at"), "fps", F.explode(F.array(*[F.lit(d).cast("long") for d in _reach()])).alias("step"))
    visits = visits.withColumn("cell", F.col("home") + F.col("step")).join(F.broadcast(cells), "cell")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("step") != 0) | (F.col("part") > F.col("at")))
    both = tiles.select("cell", "part", F.lit(False).alias("visitor"), "fps").union(visits.select("cell", "part", F.lit(True), "fps"))
    dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "visitor")
    found = common.materialize(dealt.mapInArrow(_compare_tiles, "a long, b long"), "simhash-edges")
    common.discard(cells)
    common.discard(tiles)
    return found


#: Keys that may hold more than this share of all rows: no more than this many exist.
HOT_KEYS = 10_000


def _attach(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` and ``facts`` (one row for each key, n rows of it in ``rows``, ``total`` together) without a hot task.

    Keys with more than total / HOT_KEYS rows are HOT_KEYS at most, so their facts are broadcast; the others are shuffled,
    and none of them is large.
    """
    most = total // HOT_KEYS
    hot, cold = facts.where(F.col("n") > most), facts.where(F.col("n") <= most)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp, component_id (least doc_id that links lead to, its own included).

    Links hold between any two fingerprints at three or fewer differing bits. Texts without words, null ones too, have
    fingerprint 0 and are linked like any other; a text of fewer than three words is one shingle. A null doc_id is least
    only where all of its component are null; repeated rows are rows each. Whole texts of any length, a piece at a time; an
    empty table gives no rows. Other columns are not read, whatever their names. Runs its jobs when called.
    """
    rows = common.materialize(fingerprints(docs), "simhash-fingerprints")
    nodes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    total = rows.count()
    found = edges(nodes)
    labels = components(found)
    linked = common.materialize(labels.join(nodes, labels.node == nodes.fp).select("fp", "label", "least"), "simhash-linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_linked = _attach(linked.select("label", "fp"), common.materialize(least, "simhash-components"), "label", linked.count())
    facts = nodes.join(of_linked.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    facts = common.materialize(facts, "simhash-facts")
    for done in (found, labels, linked, nodes):
        common.discard(done)
    return _attach(rows, facts, "fp", total).select("doc_id", "fp", "component_id")
