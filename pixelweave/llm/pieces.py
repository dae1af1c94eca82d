"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The text's spaces become the marker U+2581, with one marker put first. The best segmentation maximises the sum of the pieces'
scores; of equal sums the one wins whose last piece starts first, at every place. A character that no piece covers
costs ten less than the least score and is written as its UTF-8 bytes' pieces. A marker that stands in the text itself
is written as bytes too, so that decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Scores at or below are placeholders of pieces that no text is meant to be cut into.
PLACEHOLDER = -1e8
#: Distinct words in one of the two generations of a worker's cache; longer words pass uncached.
CACHE_WORDS, CACHED_LENGTH = 300_000, 64
#: Bytes of text that are cut at once: the more new words meet, the fewer numpy steps each one takes.
CHUNK_BYTES = 3 << 20


@dataclass
class Vocabulary:
    """Pieces as a double array: from state s byte b leads to base[s] + b, if check of that is s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  #: of each state the piece that ends there, or -1
    score: np.ndarray
    byte: np.ndarray  #: the piece of each byte
    text: list[bytes]
    unknown: float
    runs: bool  #: whether some piece has more than one marker at its front
    inner: bool  #: whether some piece has a marker after another character


def build_trie(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double array of byte strings and their ids. States are placed widest first, each at the first base that fits."""
    children: list[dict[int, int]] = [{}]
    ends = {0: -1}
    for text, number in pieces.items():
        s = 0
        for b in text:
            if b not in children[s]:
                children[s][b] = len(children)
                ends[len(children)] = -1
                children.append({})
            s = children[s][b]
        ends[s] = number
    size = 2 * len(children) + 512
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free, place, low = bytearray(b"\1") * size, {0: 0}, 1
    free[0] = 0
    piece[0] = ends[0]
    queue = [0]
    while queue:
        following = []
        for node in sorted(queue, key=lambda n: -len(children[n])):
            keys = list(children[node])
            if not keys:
                continue
            at = free.find(1, low)
            low = at if len(keys) == 1 else low
            first = keys[0]
            while at - first < 1 or not all(free[at - first + k] for k in keys):
                at = free.find(1, at + 1)
                if at < 0 or at + 256 >= size:
                    raise ValueError("the double array is too small")
            base[place[node]] = at - first
            for k, child in children[node].items():
                to = at - first + k
                free[to], check[to], place[child], piece[to] = 0, place[node], to, ends[child]
                following.append(child)
        queue = following
    return base, check, piece


def load(path: str, scores: Callable[[int, float], float] | None = None) -> Vocabulary:
    """Pieces, kinds and scores of a SentencePiece model file; ``scores`` may map (id, score) to another log score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text, score, byte, usable = [], np.zeros(n), np.full(256, -1, np.int32), {}
    for k in range(n):
        name = model.id_to_piece(k)
        score[k] = scores(k, model.get_score(k)) if scores else model.get_score(k)
        if model.is_byte(k):
            value = int(name[1:-1], 16)
            byte[value] = k
            text.append(bytes([value]))
        elif model.is_control(k) or model.is_unknown(k):
            text.append(b"")
        else:
            text.append(name.encode())
            usable[name.encode()] = k
    if (byte < 0).any():
        raise ValueError("the model has no byte fallback")
    base, check, piece = build_trie(usable)
    real = [score[k] for k in usable.values() if score[k] > PLACEHOLDER]
    mark = MARK.encode()
    runs = any(name.startswith(2 * mark) for name in usable)
    inner = any(MARK in name.decode("utf-8", "replace").lstrip(MARK) for name in usable)
    return Vocabulary(base, check, piece, score, byte, text, min(real, default=0.0) - 10, runs, inner)


def viterbi(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Piece ids of each word, all words at once: one numpy step for each start, length and byte."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = int(np.searchsorted(lengths[order], 1))
    while at < len(order):
        # words of like lengths together, in blocks of bounded size
        longest = lengths[order[at]] * 5 // 4 + 2
        to = min(int(np.searchsorted(lengths[order], longest, "right")), at + max(1, 4_000_000 // int(longest)))
        rows = order[at:to]
        _viterbi_block(v, [words[k] for k in rows], lengths[rows], rows, out)
        at = to
    return out


def _viterbi_block(v, words, lengths, rows, out) -> None:
    n, width = len(words), int(lengths.max())
    data = np.zeros((width + 1, n), np.uint8)
    for k, w in enumerate(words):
        data[: len(w), k] = np.frombuffer(w, np.uint8)
    best = np.full((width + 1, n), -np.inf)
    begin, taken = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -2, np.int32)
    best[0] = 0
    lead = (data & 0xC0) != 0x80
    deepest = len(max(v.text, key=len))
    for i in range(width):
        live = np.flatnonzero((lengths > i) & lead[i] & (best[i] > -np.inf))
        if not len(live):
            continue
        from_here, first = best[i], live
        # bytes of the character at i
        head = data[i, live]
        size = np.where(head < 0x80, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4)))
        single = np.zeros(len(live), bool)
        state, which = np.zeros(len(live), np.int32), np.arange(len(live))
        for j in range(i, min(width, i + deepest)):
            byte = data[j, live].astype(np.int32)
            to = v.base[state] + byte
            ok = (v.check[to] == state) & (lengths[live] > j)
            if not ok.any():
                break
            live, state, which = live[ok], to[ok], which[ok]
            number = v.piece[state]
            hit = np.flatnonzero(number >= 0)
            if len(hit):
                cols, num = live[hit], number[hit]
                single[which[hit]] |= size[which[hit]] == j + 1 - i
                value = from_here[cols] + v.score[num]
                better = value > best[j + 1, cols]
                cols = cols[better]
                best[j + 1, cols], begin[j + 1, cols], taken[j + 1, cols] = value[better], i, num[better]
        lost = np.flatnonzero(~single)
        if len(lost):
            cols, end = first[lost], i + size[lost]
            value = from_here[cols] + v.unknown
            better = value > best[end, cols]
            cols, end = cols[better], end[better]
            best[end, cols], begin[end, cols], taken[end, cols] = value[better], i, -1
    for k in range(n):
        ids, end = [], int(lengths[k])
        while end > 0:
            start, number = int(begin[end, k]), int(taken[end, k])
            ids.extend([number] if number >= 0 else v.byte[data[start:end, k]][::-1].tolist())
            end = start
        out[rows[k]] = np.array(ids[::-1], np.int32)


class Codec:
    """Encodes and decodes whole texts; a word (a marker and what follows up to the next) is segmented once.

    Segmenting word by word is exact where no piece holds a marker beyond its first place. In a vocabulary with pieces
    of several leading markers, runs of spaces stay with the word after them; with a piece that holds a marker after
    another character, a text is one word.
    """

    def __init__(self, vocabulary: Vocabulary):
        import re

        self.v, self.cache, self.older = vocabulary, {}, {}
        self.words = re.compile(r" +[^ ]*")
        self.marks = b"".join(int(vocabulary.byte[b]).to_bytes(4, "little") for b in MARK.encode())

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words too long to be cached; the others go to the cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        new = []
        for w in words:
            if w not in self.cache:
                if (x := self.older.get(w)) is not None:
                    self.cache[w] = x
                else:
                    new.append(w)
        plain = [w for w in new if MARK not in w]
        found = dict(zip(plain, (x.astype("<i4").tobytes() for x in viterbi(self.v, [w.replace(" ", MARK).encode() for w in plain])), strict=True))
        for w in new:
            if MARK in w:
                parts = viterbi(self.v, [p.replace(" ", MARK).encode() for p in w.split(MARK)])
                found[w] = self.marks.join(p.astype("<i4").tobytes() for p in parts)
        long = {}
        for w, x in found.items():
            (self.cache if len(w) <= CACHED_LENGTH else long)[w] = x
        return long

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        if self.v.inner:
            return [" " + text]
        if self.v.runs and (text[0] == " " or "  " in text):
            return self.words.findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian signed 32-bit ids of each text; an empty text has none."""
        at = 0
        while at < len(texts):
            parts, n = [], 0
            while at < len(texts) and (not parts or n < 200_000):
                parts.append(self._cut(texts[at]))
                n += len(parts[-1])
                at += 1
            long = self._learn(set().union(*parts))
            get = (lambda w: self.cache.get(w) or long[w]) if long else self.cache.__getitem__  # noqa: B023
            for p in parts:
                yield b"".join(map(get, p))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces' bytes in a row, markers as spaces but for those written as bytes, the first one dropped."""
        if not len(ids):
            return ""
        text = self.v.text
        plain = b"".join([text[k] for k in ids.tolist()])
        if self.marks in ids.astype("<i4").tobytes():
            parts, run = [], []
            byte_ids = set(self.v.byte.tolist())
            for k in ids.tolist():
                if k in byte_ids:
                    run.append(text[k])
                else:
                    parts += [b"".join(run), text[k].replace(MARK.encode(), b" ")]
                    run = []
            plain = b"".join([*parts, b"".join(run)])
        else:
            plain = plain.replace(MARK.encode(), b" ")
        return plain.decode("utf-8", "replace")[1:]


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _encode(shared, with_ids: bool):
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_Keyed(shared))
        for batch in batches:
            _, offsets = common.string_buffers(batch.column("text"))
            for a, b in common.row_chunks(offsets, CHUNK_BYTES):
                texts = [x or "" for x in batch.column("text").slice(a, b - a).to_pylist()]
                raw = list(codec.encode(texts))
                n = np.array([len(r) // 4 for r in raw], np.int64)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n)]
                if with_ids:
                    values = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values))
                else:
                    columns.append(pa.array([zlib.crc32(r) for r in raw], pa.int64()))
                    columns.append(pa.array([codec.decode(np.frombuffer(r, "<i4")) == t for r, t in zip(raw, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "pieces"] if with_ids else ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


class _Keyed:
    """A broadcast value under a key that is the same for all tasks of a worker."""

    def __init__(self, shared):
        self.id, self._shared = getattr(shared, "_jid", None) or str(shared), shared

    @property
    def value(self):
        return self._shared.value


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, pieces (ids) of every row, in any order; repeated rows give a row each.

    A null or empty text has no pieces; a text of any length is segmented whole, in words. Other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    return _narrow(docs).mapInArrow(_encode(shared, True), "doc_id long, n_pieces long, pieces array<int>")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, crc32 of the ids as little-endian 32-bit integers, and whether decoding gives the text again.

    Rows as those of ``encode``; a null text counts as the empty one, whose crc32 is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    return _narrow(docs).mapInArrow(_encode(shared, False), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
