"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are runs of five words. A shingle weighs its count in the text times its inverse document frequency, which is
the mean of its words' ln(1 + N / df); df counts all documents, by hashed word (65,536 buckets, so what is broadcast has
a fixed size at any corpus size). Two texts are near-duplicates at a weighted Jaccard similarity of 0.8 or more; classes
are the connected components.

Texts of equal words are one node from the start. Nodes that share a band's samples are candidates. First every member
of a band is compared with one hub of it; what then lies in one class needs no more comparison. The members of a band in
different classes are all compared: in bands of few members as pairs (at most SMALL for each member), unless their weights
(Jaccard cannot exceed their ratio) or samples rule it out; larger bands are joined into clumps, cut into blocks of about
BLOCK nodes, and each two blocks are compared as matrices in a task of their own, so no row is made for a pair and no
group meets in one task. Either way every pair of similar texts that share a band is found, but for the one in a million
that agrees in fewer than LEAST_EQUAL samples; clumps may find similar texts that share no band besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes
from .components import components

SIZE = 5
SIMILARITY = 0.8
BUCKETS = 1 << 16
#: 12 bands of 3 samples: a pair of similarity 0.8 shares one with probability 0.9998, of 0.9 with 1 - 1e-7.
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Equal samples of 36 below which a pair is not compared: a pair of similarity 0.8 has fewer with probability 1e-6.
LEAST_EQUAL = 16
#: Members up to which a band's pairs are made as rows, nodes of a block, and shingles that are compared at once.
SMALL, BLOCK, COLUMNS = 32, 256, 4096

_U = np.uint64


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(48)).astype(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows_seen = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        data, offsets = common.string_buffers(batch.column("text"))
        for a, b in common.row_chunks(offsets):
            rows, hashes, _, _ = textbytes.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            counts += np.bincount(np.unique(rows * BUCKETS + word_buckets(hashes)) % BUCKETS, minlength=BUCKETS)
        rows_seen += batch.num_rows
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1])).astype(np.int32)), pa.array(np.concatenate((counts[at], [rows_seen])))], names=["bucket", "n"])


def word_weights(docs: DataFrame) -> np.ndarray:
    """ln(1 + N / df) of each word bucket over all rows; 65,537 sums reach the driver at most."""
    counts = docs.select(common.text_or_empty("text").alias("text")).mapInArrow(_document_counts, "bucket int, n long")
    with common.small_batches(docs.sparkSession):
        sums = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.float64)
    df[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return np.log1p(df[-1] / np.maximum(df[:-1], 1)).astype(np.float32)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of distinct shingles by row and hash, and the rows' 128-bit keys of words."""
    n = len(offsets) - 1
    rows, hashes, _, _ = textbytes.words(data, offsets)
    keys = textbytes.text_keys(rows, hashes, n)
    at_row, shingle, first = textbytes.shingles(rows, hashes, n, SIZE)
    if not len(at_row):
        return at_row, shingle, np.zeros(0, np.float32), keys
    run = np.concatenate(([0.0], np.cumsum(idf[word_buckets(hashes)], dtype=np.float64)))
    last = np.minimum(first + SIZE, np.searchsorted(rows, at_row, "right"))
    weight = (run[last] - run[first]) / (last - first)
    order = np.lexsort((shingle, at_row))
    at_row, shingle, weight = at_row[order], shingle[order], weight[order]
    new = np.concatenate(([True], (at_row[1:] != at_row[:-1]) | (shingle[1:] != shingle[:-1])))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(new)))
    # rounded, so that a shingle weighs the same wherever it stands
    return at_row[begin], shingle[begin], (np.round(weight[begin] * 1024) / 1024 * count).astype(np.float32), keys


def _samplers() -> np.ndarray:
    return textbytes.mix(np.arange(1, SAMPLES + 1, dtype=_U) * _U(0xD6E8FEB86659FD93))


def consistent_samples(at_row: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, their samples (rows, 36) of 64 bits).

    For each shingle and sampler: r and c of Gamma(2, 1), b uniform, from the shingle's hash; t = floor(ln w / r + b),
    y = exp(r (t - b)), a = c / (y e^r); the sample is the shingle of least a with its t.
    """
    if not len(at_row):
        return np.zeros(0, np.int64), np.zeros((0, SAMPLES), _U)
    present, begin = np.unique(at_row, return_index=True)
    counts = np.diff(np.append(begin, len(at_row)))
    log_w = np.log(weight)
    out = np.empty((len(present), SAMPLES), _U)
    f = np.float32
    for k, seed in enumerate(_samplers()):
        z = textbytes.mix(shingle ^ seed)
        y = textbytes.mix(z + _U(0x9E3779B97F4A7C15))
        u1, u2, b = (((z >> _U(s)) & _U(0xFFFFF)).astype(f) for s in (0, 20, 40))
        u3, u4 = ((y & _U(0xFFFFFFFF)).astype(f), (y >> _U(32)).astype(f))
        r = -np.log((u1 + f(0.5)) * f(2.0**-20)) - np.log((u2 + f(0.5)) * f(2.0**-20))
        c = -np.log((u3 + f(0.5)) * f(2.0**-32)) - np.log((u4 + f(0.5)) * f(2.0**-32))
        b = b * f(2.0**-20)
        t = np.floor(log_w / r + b)
        a = np.log(np.maximum(c, f(1e-30))) - r * (t - b + f(1))
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, counts))
        row, first = np.unique(np.searchsorted(begin, hit, "right") - 1, return_index=True)
        at = hit[first]
        out[row, k] = textbytes.mix(shingle[at] ^ (t[at].astype(np.int64).astype(_U) * _U(0xA24BAED4963EE407)))
    return present, out


NODE_FIELDS = "doc_id long, raw long, node binary, weight double, samples binary"


def _sketch(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.string_buffers(batch.column("text"))
            for a, b in common.row_chunks(offsets):
                at_row, shingle, weight, keys = weighted_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf.value)
                present, samples = consistent_samples(at_row, shingle, weight)
                total = np.bincount(at_row, weight, minlength=b - a)
                packed: list[bytes | None] = [None] * (b - a)
                for row, sample in zip(present.tolist(), samples, strict=True):
                    packed[row] = sample.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("raw").slice(a, b - a), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(total, pa.float64()), pa.array(packed, pa.binary())], names=["doc_id", "raw", "node", "weight", "samples"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        samples = np.frombuffer(b"".join(batch.column("samples").to_pylist()), _U).reshape(-1, BANDS, ROWS)
        keys = np.zeros(samples.shape[:2], _U)
        for j in range(ROWS):
            keys = textbytes.mix(keys ^ samples[:, :, j])
        keys = textbytes.mix(keys + np.arange(BANDS, dtype=_U))
        rows = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), *[batch.column(c).take(rows) for c in ("node", "weight")]], names=["band", "node", "weight"])


def _similarity(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [common.string_buffers(batch.column(c)) for c in ("text_a", "text_b")]
            out, at = np.zeros(batch.num_rows), 0
            for _, to in common.row_chunks(sides[0][1] + sides[1][1]):
                found = [weighted_shingles(d[o[at] : o[to]], o[at : to + 1] - o[at], idf.value)[:3] for d, o in sides]
                row, shingle, weight = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((shingle, row))
                row, shingle, weight = row[order], shingle[order], weight[order].astype(np.float64)
                same = np.flatnonzero((row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1])) if len(row) else np.zeros(0, np.int64)
                both = np.bincount(row[same], np.minimum(weight[same], weight[same + 1]), minlength=to - at)
                total = np.bincount(row, weight, minlength=to - at)
                out[at:to] = both / np.maximum(total - both, 1e-12)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "similarity"])

    return run


def _items(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, weight): a shingle that occurs n times is n items of its weight, so common items add up to the lesser weight."""
    parts = []
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for a, b in common.row_chunks(offsets):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        n_rows = b - a
        rows, hashes, _, _ = textbytes.words(data, offsets[a : b + 1] - offsets[a])
        row, shingle, first = textbytes.shingles(rows, hashes, n_rows, SIZE)
        _, _, once, _ = weighted_shingles(data, offsets[a : b + 1] - offsets[a], idf)
        if not len(row):
            continue
        order = np.lexsort((shingle, row))
        row, shingle = row[order], shingle[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])))
        which = np.cumsum(new) - 1
        nth = np.arange(len(row)) - np.flatnonzero(new)[which]
        each = (once / np.bincount(which))[which]
        parts.append((row + a, np.where(nth > 0, textbytes.mix(shingle + nth.astype(_U)), shingle), each))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _blocks(idf, similarity: float):
    def run(table):
        left = table.column("left").to_numpy(zero_copy_only=False)
        names, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
        n = len(names)
        side = [np.flatnonzero(left | table.column("same").to_numpy(zero_copy_only=False)), np.flatnonzero(~left | table.column("same").to_numpy(zero_copy_only=False))]
        none = pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "similarity": pa.array([], pa.float64())})
        _, label = np.unique(np.array(labels, object), return_inverse=True)
        if label.max(initial=0) == 0 or not len(side[0]) or not len(side[1]):
            return none
        row, item, weight = _items([t.encode() for t in table.column("text").to_pylist()], idf.value)
        total = np.bincount(row, weight, minlength=n)
        values, column, count = np.unique(item, return_inverse=True, return_counts=True)
        keep = count[column] > 1
        row, weight = row[keep], weight[keep]
        _, column = np.unique(column[keep], return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, weight, column = row[order], weight[order], column[order]
        both = np.zeros((n, n), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (a, a + COLUMNS))
            dense = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
            dense[row[lo:hi], column[lo:hi] - a] = np.sqrt(weight[lo:hi])
            both += dense @ dense.T
        found = both[np.ix_(*side)].astype(np.float64)
        found /= np.maximum(total[side[0]][:, None] + total[side[1]][None] - found, 1e-12)
        i, j = np.nonzero((found >= similarity - 1e-3) & (label[side[0]][:, None] != label[side[1]][None]))
        a, b = side[0][i], side[1][j]
        exact = np.array([_exact(row, column, weight, x, y, total) for x, y in zip(a, b, strict=True)])
        ok = np.flatnonzero(exact >= similarity) if len(a) else []
        return pa.table({"a": pa.array([names[a[k]] for k in ok], pa.binary()), "b": pa.array([names[b[k]] for k in ok], pa.binary()), "similarity": pa.array([float(exact[k]) for k in ok], pa.float64())})

    return run


def _exact(row, column, weight, x: int, y: int, total) -> float:
    """The similarity of two texts of a block in double precision (products above are single)."""
    one, two = row == x, row == y
    both = float(weight[one][np.isin(column[one], column[two])].sum())
    return both / max(total[x] + total[y] - both, 1e-12)


def _raw():
    """Hash of the text as it stands; a null text is not the empty one."""
    return F.xxhash64(F.col("text").cast("string")).alias("raw")


class NearDuplicates:
    """The whole job on one table; its steps are kept as tables in the shared folder."""

    def __init__(self, docs: DataFrame, similarity: float = SIMILARITY):
        self.spark, self.similarity = docs.sparkSession, similarity
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"), _raw())
        self.idf = self.spark.sparkContext.broadcast(word_weights(docs))

    def sketches(self) -> DataFrame:
        """doc_id, raw (hash of the text as it stands), node (of its words), total weight, samples (null without words)."""
        return common.materialize(self.docs.mapInArrow(_sketch(self.idf), NODE_FIELDS), "near-sketches")

    def links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Verified pairs: texts of both nodes are fetched from the table by doc_id, in two joins."""
        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes)
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        found = both.select("a", "b", "text_a", "text_b").mapInArrow(_similarity(self.idf), "a binary, b binary, similarity double")
        return common.materialize(found.where(F.col("similarity") >= self.similarity), "near-links")

    def classes(self) -> DataFrame:
        """doc_id, raw, class_id (least doc_id of the class) of every row of the table.

        A null text has no words; texts without words are a class with their exact like (null with null, empty with
        empty) and never linked to others.
        """
        rows = self.sketches()
        worded = rows.where(F.col("samples").isNotNull())
        nodes = worded.groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.min("weight").alias("weight"), F.min("samples").alias("samples"))
        nodes = common.materialize(nodes, "near-nodes")
        bands = nodes.select("node", "weight", "samples").mapInArrow(_bands, "band long, node binary, weight double")
        bands = common.materialize(bands, "near-bands")
        shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
        bands = common.materialize(bands.join(shared, "band"), "near-shared-bands")
        hub = bands.groupBy("band").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "weight")).alias("hub"))
        star = bands.join(hub, "band").where(F.col("node") != F.col("hub.node")).select("node", F.col("hub.node").alias("other"), "weight", F.col("hub.weight").alias("other_weight"))
        links = self.links(self._fitting(star), nodes)
        labels = components(links.select("a", "b"))
        members = bands.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = members.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.min("node").alias("hub")).where(F.col("x") != F.col("y")).select("band", "size", "hub")
        members = common.materialize(members.join(mixed, "band"), "near-mixed")
        pairs = self._fitting(self._across(members.where(F.col("size") <= SMALL), nodes))
        more = self.links(pairs, nodes)
        large = members.where(F.col("size") > SMALL)
        if large.take(1):
            more = more.union(self._clumps(large, nodes))
        if more.take(1):
            labels = components(links.union(more).select("a", "b"))
        out = rows.join(labels, "node", "left")
        own = F.encode(F.concat(F.lit("raw:"), F.col("raw").cast("string")), "utf-8")
        out = out.select("doc_id", "raw", F.when(F.col("samples").isNotNull(), F.coalesce("label", "node")).otherwise(own).alias("label"))
        least = out.groupBy("label").agg(F.min(F.struct("doc_id", "raw")).alias("keep"), F.count("*").alias("class_size"))
        return out.join(least, "label").select("doc_id", "raw", F.col("keep.doc_id").alias("class_id"), "class_size", "keep")

    def _fitting(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) whose total weights don't rule the similarity out."""
        fits = F.least("weight", "other_weight") >= F.lit(self.similarity - 1e-6) * F.greatest("weight", "other_weight")
        out = pairs.where(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        return common.materialize(out, "near-pairs")

    def _across(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs of small bands in different classes with enough equal samples."""
        rows = members.join(nodes.select("node", "samples"), "node").select("band", "node", "weight", "label", "samples")
        right = rows.withColumnsRenamed({"node": "other", "weight": "other_weight", "label": "other_label", "samples": "other_samples"})
        pairs = rows.join(right, "band").where((F.col("label") < F.col("other_label")))
        equal = sum((F.substring("samples", 8 * j + 1, 8) == F.substring("other_samples", 8 * j + 1, 8)).cast("int") for j in range(SAMPLES))
        return pairs.where(equal >= LEAST_EQUAL).select("node", "other", "weight", "other_weight")

    def texts(self, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
        """node, text of the given nodes, fetched from the table by doc_id."""
        names = wanted.join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("w_id"), F.col("first.raw").alias("w_raw"))
        found = self.docs.join(names, self.docs.doc_id.eqNullSafe(F.col("w_id")) & (self.docs.raw == F.col("w_raw"))).select("node", "text")
        return common.materialize(found.groupBy("node").agg(F.min("text").alias("text")), "near-texts")

    def _clumps(self, large: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links across classes inside clumps of large bands, two blocks of nodes at a time."""
        clump = components(large.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("label", "clump")
        of = large.select("node", "label").distinct().join(clump, "node")
        sizes = of.groupBy("clump").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        rows = of.join(sizes, "clump").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
        rows = rows.join(self.texts(of.select("node"), nodes), "node")
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("node", "label", "text", "clump", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), (F.col("block") <= F.col("k")).alias("left"), (F.col("block") == F.col("k")).alias("same"))
        found = rows.groupBy("clump", "i", "j").applyInArrow(_blocks(self.idf, self.similarity), "a binary, b binary, similarity double")
        return common.materialize(found, "near-links")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id (least doc_id of the class), class_size.

    Other columns are not read, whatever their names. A null text is of a class with null texts, and any text without
    words with its exact copies; a null doc_id is the least only where all are null. Repeated rows are rows of their class
    each. Texts of any length are compared whole; an empty table gives no rows. Runs its jobs when called.
    """
    return NearDuplicates(docs, similarity).classes().select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The document of least doc_id of each class, once; columns of ``docs``, whatever their names. Rows as for ``classes``.

    Rows that agree in doc_id and text are repeated rows: one of them stays.
    """
    job = NearDuplicates(docs, similarity)
    found = job.classes()
    kept = found.where((F.col("keep.raw") == F.col("raw")) & F.col("keep.doc_id").eqNullSafe(F.col("doc_id")))
    kept = common.materialize(kept.groupBy(F.col("doc_id").alias("nd_id"), F.col("raw").alias("nd_raw")).agg(F.count("*").alias("nd_n")), "near-kept")
    rows = docs.select(common.row_of(docs).alias("nd_row"), F.col("doc_id").cast("long").alias("nd_doc"), _raw().alias("nd_key"))
    out = rows.join(kept, F.col("nd_doc").eqNullSafe(F.col("nd_id")) & (F.col("nd_key") == F.col("nd_raw")))
    once = out.where("nd_n = 1")
    if kept.where("nd_n > 1").take(1):
        once = once.unionByName(out.where("nd_n > 1").dropDuplicates(["nd_id", "nd_raw"]))
    return once.select("nd_row.*")
