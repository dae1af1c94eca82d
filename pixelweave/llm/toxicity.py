"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

#: Bounds of the labelled sample that the model is fitted on: rows of each label, and bytes of a text.
SAMPLE_ROWS = 2000
SAMPLE_TEXT_BYTES = 1 << 14
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 4
ROUNDS = 64
#: Of training: step length, and rows of the sample in which a subword must occur.
RATE, LEAST_ROWS, PADDING = 4.0, 5, 20.0


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the subwords of words: byte n-grams of the word between two marks, and the word itself."""
    n, sizes = len(starts), ends - starts
    low = textbytes.LOWER[data]
    total = int(sizes.sum())
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)
    # one mark before each word and one at the end; a word's grams run from its mark to the next one
    marked = np.ones(total + n + 1, np.uint8)
    marked[np.arange(total) + np.repeat(np.arange(n), sizes) + 1] = low[inside]
    at = np.concatenate(([0], np.cumsum(sizes)[:-1])) + np.arange(n)
    up, down = textbytes.powers(len(marked) + 1)
    run = np.zeros(len(marked) + 1, np.uint64)
    np.cumsum(marked * up[: len(marked)], out=run[1:])
    words, grams = [np.arange(n)], [textbytes.mix((run[at + sizes + 2] - run[at]) * down[at] + np.uint64(1))]
    for size in SIZES:
        count = np.maximum(sizes + 2 - size + 1, 0)
        word = np.repeat(np.arange(n), count)
        first = np.repeat(at - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        words.append(word)
        grams.append(textbytes.mix((run[first + size] - run[first]) * down[first] + np.uint64(size)))
    return np.concatenate(words), np.concatenate([(g % np.uint64(BUCKETS)).astype(np.int32) for g in grams])


@dataclass
class Model:
    """Both classes' scores of a text are linear in the mean, over its words, of means of subword vectors.

    A word that occurs n times counts log2(1 + n) times, so that a run of one word doesn't fill the mean, and PADDING neutral words
    are added, so that very short texts stay near the bias.
    """

    weight: np.ndarray  #: of each subword bucket: its embedding times the difference of the classes' rows of the softmax
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row; a text without words has that of the bias."""
        n = len(offsets) - 1
        rows, hashes, starts, ends = textbytes.words(data, offsets)
        z = np.full(n, self.bias)
        if len(rows):
            _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
            part, bucket = subwords(data, starts[first], ends[first])
            each = np.bincount(part, self.weight[bucket]) / np.bincount(part)
            pairs, count = np.unique(rows * len(first) + word, return_counts=True)
            rows, word, count = pairs // len(first), pairs % len(first), np.log2(1 + count)
            z += np.bincount(rows, each[word] * count, minlength=n) / (np.bincount(rows, count, minlength=n) + PADDING)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class _Rows:
    """A sparse matrix by rows and by columns; products run over one dimension of the vectors at a time."""

    def __init__(self, rows, columns, values, n_rows, n_columns):
        self.forward = self._runs(rows, columns, values, n_rows)
        self.backward = self._runs(columns, rows, values, n_columns)

    @staticmethod
    def _runs(rows, columns, values, n):
        order = np.argsort(rows, kind="stable")
        present, first = np.unique(rows[order], return_index=True)
        return columns[order].astype(np.int32), values[order].astype(np.float32), present, first, n

    @staticmethod
    def times(runs, vectors):
        """vectors: (dimensions, columns) → (dimensions, rows)."""
        columns, values, present, first, n = runs
        out = np.zeros((len(vectors), n), np.float32)
        if len(first):
            for d, x in enumerate(vectors):
                out[d, present] = np.add.reduceat(x[columns] * values, first)
        return out


def _features(texts: list[bytes]) -> tuple[_Rows, _Rows, np.ndarray] | None:
    """Rows by their words' shares, words by their subwords' shares, and in how many rows each subword occurs."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = []
    for a, b in common.row_chunks(offsets):
        rows, h, s, e = textbytes.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append((rows + a, h, s + offsets[a], e + offsets[a]))
    doc, hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(doc):
        return None
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    part, bucket = subwords(data, starts[first], ends[first])
    n, v = len(texts), len(first)
    pair, count = np.unique(doc * v + word, return_counts=True)
    count = np.log2(1 + count)
    in_doc = _Rows(pair // v, pair % v, count / (np.bincount(pair // v, count, minlength=n) + PADDING)[pair // v], n, v)
    rows_with = _rows_with(pair // v, pair % v, part, bucket)
    keep = rows_with[bucket] >= LEAST_ROWS  # the others' vectors stay zero
    sizes = np.bincount(part, minlength=v)
    part, bucket = part[keep], bucket[keep]
    return in_doc, _Rows(part, bucket, 1 / sizes[part], v, BUCKETS), rows_with


def _rows_with(doc: np.ndarray, word: np.ndarray, part: np.ndarray, bucket: np.ndarray, at_once: int = 100_000) -> np.ndarray:
    """In how many rows each subword bucket occurs; (doc, word) in order of doc."""
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part)
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out, a = np.zeros(BUCKETS, np.int64), 0
    while a < len(doc):
        b = int(np.searchsorted(doc, doc[min(a + at_once, len(doc)) - 1], "right"))
        n = sizes[word[a:b]]
        at = np.repeat(firsts[word[a:b]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        seen = np.unique(np.repeat(doc[a:b], n) * BUCKETS + bucket[order[at]].astype(np.int64))
        out += np.bincount(seen % BUCKETS, minlength=BUCKETS)
        a = b
    return out


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 0, rounds: int = ROUNDS) -> Model:
    """Train embeddings and softmax together on the weighted log loss, by gradient descent with momentum.

    A tenth of the rows (by position) only choose the round whose model is kept. Without rows of both labels, or
    without words, the model is the constant share of label 1.
    """
    labels, weights = np.asarray(labels, np.int64), np.asarray(weights, np.float64)
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    constant = Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-4) / max(1 - share, 1e-4))))
    features = _features(texts) if len(set(labels.tolist())) == 2 else None
    if features is None:
        return constant
    in_doc, in_word, rows_with = features
    n, rng = len(texts), np.random.default_rng(seed)
    # a subword's vector is scaled by its rarity; one of too few rows can't be told from chance and stays zero
    rarity = np.where(rows_with >= LEAST_ROWS, np.sqrt(n / np.maximum(rows_with, 1)), 0).astype(np.float32)
    embed = (rng.standard_normal((DIMENSIONS, BUCKETS)) * 1e-3).astype(np.float32)
    soft = np.linspace(-1, 1, 2 * DIMENSIONS, dtype=np.float32).reshape(2, DIMENSIONS)
    bias = np.array([0.0, constant.bias], np.float32)
    check = np.arange(n) % 10 == 3
    if len(set(labels[~check].tolist())) < 2 or len(set(labels[check].tolist())) < 2:
        check[:] = False
    share_of = np.where(check, 0, weights)
    share_of = (share_of / share_of.sum()).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[:, labels]
    places = (embed, soft, bias)
    moves = [np.zeros_like(x) for x in places]
    best, kept, last, rate, scale = np.inf, constant, np.inf, RATE, None
    judged = check if check.any() else ~check
    probe = _Rows.times(in_doc.forward, _Rows.times(in_word.forward, rng.standard_normal((8, BUCKETS)).astype(np.float32) * rarity))
    scale = 1 / max(float(np.sqrt((probe**2).mean())), 1e-9)  # a text's features then have length one
    for k in range(1, rounds + 1):
        hidden = _Rows.times(in_doc.forward, _Rows.times(in_word.forward, embed * rarity)) * scale
        z = soft @ hidden + bias[:, None]
        z -= z.max(axis=0)
        p = np.exp(z)
        p /= p.sum(axis=0)
        losses = -np.log(np.maximum(p[labels, np.arange(n)], 1e-9))
        loss, learned = float(np.average(losses[judged], weights=weights[judged])), float((losses * share_of).sum())
        if loss < best:
            best, kept = loss, Model(((soft[1] - soft[0]) @ embed) * rarity * scale, float(bias[1] - bias[0]))
        if learned > last:
            rate, moves = rate / 2, [m * 0 for m in moves]
        last = learned
        dz = (p - target) * share_of
        grads = (_Rows.times(in_word.backward, _Rows.times(in_doc.backward, (soft.T @ dz) * scale)) * rarity, dz @ hidden.T, dz.sum(axis=1))
        for x, g, m in zip(places, grads, moves, strict=True):
            m *= 0.9
            m -= rate * g
            x += m
    return kept


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """tx_id, tx_label, tx_weight, tx_text of at most ``rows`` rows of each label, by a hash of doc_id, none held out.

    Weights carry each label's share of all labelled rows that may be learned from. Where several labels name an id the
    highest counts. Texts over SAMPLE_TEXT_BYTES are not in the sample (they are scored whole all the same). None
    without labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("tx_id")).agg(F.max(F.col("toxic").cast("int")).alias("tx_label"))
    known = known.where(~held_out(F.col("tx_id")) & F.col("tx_label").isin(0, 1))
    totals = {r.tx_label: r["count"] for r in known.groupBy("tx_label").count().collect()}
    chosen = []
    for label in sorted(totals):
        chosen += [tuple(r) for r in common.by_hash(known.where(F.col("tx_label") == label), F.col("tx_id"), totals[label], rows).collect()]
    if not chosen:
        return None
    weight = {k: totals[k] / sum(c[1] == k for c in chosen) for k in totals}
    small = labels.sparkSession.createDataFrame([(*c, weight[c[1]]) for c in chosen], "tx_id long, tx_label int, tx_weight double")
    texts = docs.select(F.col("doc_id").cast("long").alias("tx_id"), common.text_or_empty("text").cast("binary").alias("tx_text")).where(F.octet_length("tx_text") <= SAMPLE_TEXT_BYTES)
    # at most 2 * rows ids are broadcast; repeated rows of an id are taken once
    return texts.join(F.broadcast(small), "tx_id").groupBy("tx_id", "tx_label", "tx_weight").agg(F.min("tx_text").alias("tx_text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 0) -> Model:
    """Fit on the labelled sample, in one task: its size is bounded, and the driver only gets the weights."""
    sample = labelled_sample(docs, labels, rows)
    if sample is None:
        return fit([], np.zeros(0), np.zeros(0), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        some = pa.Table.from_batches(held)
        model = fit(some.column("tx_text").to_pylist(), some.column("tx_label").to_numpy(), some.column("tx_weight").to_numpy(), seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    one = sample.repartition(1).sortWithinPartitions(F.md5(F.col("tx_id").cast("string")), "tx_id", "tx_label")
    got = one.mapInArrow(run, "weight binary, bias double").collect()
    if not got:
        return fit([], np.zeros(0), np.zeros(0), seed)
    return Model(np.frombuffer(bytes(got[0].weight), "<f4"), got[0].bias)


def add_score(docs: DataFrame, model: Model, name: str = "tx_score") -> DataFrame:
    """``docs`` with the score of every whole text (null: empty); only the text is read by the model.

    All other columns stay, but one called ``name`` gives way to the score. Repeated rows score alike; texts of any
    length are read whole; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return _scored(shared.value, texts)

    return docs.withColumn(name, score(common.text_or_empty("text")))


def _scored(model: Model, texts: pa.Array) -> pa.Array:
    data, offsets = common.string_buffers(texts)
    parts = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.row_chunks(offsets)]
    return pa.array(np.concatenate([*parts, np.zeros(0)]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row, whatever its doc_id; a null text is empty, and a text without words has the bias's score.

    Texts of any length are read whole; repeated rows give a row each, an empty table none. Other columns are not read,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _scored(shared.value, batch.column("text"))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
