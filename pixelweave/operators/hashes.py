"""Perceptual hashes as 64-bit longs, and similarity joins on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantum import luma
from .geometry import sizes

BITS = 64


def _sampled(df: DataFrame, w: int, h: int) -> DataFrame:
    """image_id, sy, sx, l: luma at nearest places of a w x h grid."""
    at = df.join(sizes(df), "image_id")
    # a pixel is taken by the grid places whose int(i * scale) it is
    near = lambda n, size, c: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least((i * F.col(size) / n).cast("int"), F.col(size) - 1) == F.col(c))
    rows = at.select("image_id", luma().alias("l"), near(h, "h", "y").alias("ys"), near(w, "w", "x").alias("xs")).where((F.size("ys") > 0) & (F.size("xs") > 0))
    return rows.select("image_id", "l", F.explode("ys").alias("sy"), "xs").select("image_id", "l", "sy", F.explode("xs").alias("sx"))


def _pack(bit: Column, place: Column) -> Column:
    return F.bit_or(F.when(bit, F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))


def average_hash(df: DataFrame) -> DataFrame:
    """image_id, hash: bit set where an 8 x 8 sample reaches the mean."""
    s = _sampled(df, 8, 8).withColumn("m", F.avg("l").over(Window.partitionBy("image_id")))
    return s.groupBy("image_id").agg(_pack(F.col("l") >= F.round("m", 6), (F.col("sy") * 8 + F.col("sx")).cast("int")).alias("hash"))


def difference_hash(df: DataFrame) -> DataFrame:
    """Bit set where a sample exceeds its right neighbour, 9 x 8."""
    line = Window.partitionBy("image_id", "sy").orderBy("sx")
    s = _sampled(df, 9, 8).withColumn("right", F.lead("l").over(line)).where("sx < 8")
    return s.groupBy("image_id").agg(_pack(F.col("l") > F.col("right"), (F.col("sy") * 8 + F.col("sx")).cast("int")).alias("hash"))


def wavelet_hash(df: DataFrame) -> DataFrame:
    """One Haar level on rows, then columns, of an 8 x 8 sample; bit set at or above the upper median."""
    root = math.sqrt(0.5)

    def level(d: DataFrame, axis: str) -> DataFrame:
        half, odd = F.floor(F.col(axis) / 2).cast("int"), F.col(axis) % 2
        other = "sy" if axis == "sx" else "sx"
        p = d.groupBy("image_id", other, half.alias("k")).agg(F.sum("l").alias("s"), F.sum(F.when(odd == 0, F.col("l")).otherwise(-F.col("l"))).alias("d"))
        return p.select("image_id", other, F.explode(F.array(F.struct(F.col("k").alias("i"), (F.col("s") * root).alias("l")), F.struct((F.col("k") + 4).alias("i"), (F.col("d") * root).alias("l")))).alias("e")).select("image_id", other, F.col("e.i").alias(axis), F.col("e.l").alias("l"))

    c = level(level(_sampled(df, 8, 8), "sx"), "sy").withColumn("l", F.round("l", 6))
    mid = c.groupBy("image_id").agg(F.element_at(F.array_sort(F.collect_list("l")), 33).alias("m"))
    return c.join(mid, "image_id").groupBy("image_id").agg(_pack(F.col("l") >= F.col("m"), (F.col("sy") * 8 + F.col("sx")).cast("int")).alias("hash"))


def perceptual_hash(df: DataFrame) -> DataFrame:
    """Low frequencies of the 2-D DCT of a 32 x 32 sample, without the constant one; bit set at or above the median."""
    s = _sampled(df, 32, 32)
    cosine = lambda n, k: F.cos((n * 2 + 1) * k * (math.pi / 64))
    terms = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(u).alias("u")) for v in range(8) for u in range(8) if u or v])
    spread = s.withColumn("t", F.explode(terms))
    dct = spread.groupBy("image_id", F.col("t.v").alias("v"), F.col("t.u").alias("u")).agg(F.round(F.sum(F.col("l") * cosine(F.col("sx"), F.col("t.u")) * cosine(F.col("sy"), F.col("t.v"))), 3).alias("d"))
    mid = dct.groupBy("image_id").agg(F.element_at(F.array_sort(F.collect_list("d")), 32).alias("m"))
    return dct.join(mid, "image_id").groupBy("image_id").agg(_pack(F.col("d") >= F.col("m"), (F.col("v") * 8 + F.col("u") - 1).cast("int")).alias("hash"))


def to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex(text: Column) -> Column:
    """Signed long of 16 hexadecimal digits."""
    high, low = (F.conv(F.substring(text, k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Tiles of distinct hashes, and pairs of hashes that are compared at once.
TILES, PAIRS = 64, 1 << 18
#: Parts of a hash of which one is equal where fewer bits differ.
BANDS = 4


def _links(most: int):
    """Links within a tile, or between the two tiles that follow each other as one pair."""

    def compare(h: np.ndarray, first: np.ndarray, other: np.ndarray, other_first: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // max(1, len(other)))
        for at in range(0, len(h), step):
            d = np.bitwise_count(h[at : at + step, None] ^ other[None])
            i, j = np.nonzero(d <= most)
            a, b = first[at + i], other_first[j]
            # of a tile and itself every pair stands twice
            ok = a < b if h is other else np.ones(len(a), bool)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(d[i, j][ok].astype(np.int32))], names=["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None, None, None
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("pair", "tile", "hashes", "firsts")], strict=True):
                pair, tile = row[0].as_py(), row[1].as_py()
                h, first = (v.values.to_numpy() for v in row[2:])
                h = h.view(np.uint64)  # of signed values bits are counted without the sign
                if pair == tile * TILES + tile:
                    yield from compare(h, first, h, first)
                elif held[0] == pair:
                    yield from compare(*held[1:], h, first)
                held = pair, h, first

    return run


def _by_tile(distinct: DataFrame, most: int) -> DataFrame:
    tiles = distinct.groupBy(F.pmod(F.xxhash64("hash"), F.lit(TILES)).alias("tile")).agg(F.collect_list(F.struct("hash", "first")).alias("p")).select("tile", F.col("p.hash").alias("hashes"), F.col("p.first").alias("firsts"))
    met = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))).withColumn("pair", F.least("tile", "other") * TILES + F.greatest("tile", "other")).drop("other")
    return met.repartition("pair").sortWithinPartitions("pair", "tile").mapInArrow(_links(most), "a long, b long, distance int")


def _by_band(distinct: DataFrame, most: int) -> DataFrame:
    width = BITS // BANDS
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", k * width).bitwiseAND((1 << width) - 1).alias("value")) for k in range(BANDS)]))
    left = distinct.select("hash", "first", bands.alias("at")).select("hash", "first", "at.band", "at.value")
    right = left.select(F.col("hash").alias("other"), F.col("first").alias("other_first"), "band", "value")
    near = distance(F.col("hash"), F.col("other"))
    met = left.hint("merge").join(right, ["band", "value"]).where((F.col("first") < F.col("other_first")) & (near <= most))
    return met.select(F.col("first").alias("a"), F.col("other_first").alias("b"), near.alias("distance")).distinct()


def similar(hashes: DataFrame, most: int = 10) -> DataFrame:
    """Every link between images whose hashes differ in at most ``most`` bits: a, b (a < b), distance.

    Images of equal hashes are one row during the search: links between different hashes stand between the least images
    of each, and every further image of a hash is linked to that least one at distance 0, so none is lost and a group of n
    equal images has n - 1 rows. Distinct hashes are dealt into TILES tiles; each pair of tiles meets in one task, where all
    their hashes are compared by exclusive-or and bit counts, PAIRS at a time. Up to three bits are looked up instead: of four
    bands one is equal then, an equi-join. More bits hold for a share of all pairs, and flipped bands cost hundreds of rows a hash.
    """
    if not 0 <= most < 16:
        raise ValueError("at most 15 bits can differ")
    distinct = hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min("image_id").alias("first"))
    pairs = _by_band(distinct, most) if most < BANDS else _by_tile(distinct, most)
    members = hashes.join(distinct, "hash").where("image_id <> first").select(F.col("first").alias("a"), F.col("image_id").alias("b"), F.lit(0).alias("distance"))
    return pairs.union(members)
