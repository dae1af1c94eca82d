"""Token ids in files of patched frame-of-reference blocks.

A file (``.pfor``) holds whole documents in ascending order of doc_id::

    magic 'PFB1' | u32 n_docs | u64 n_tokens | u64 before (tokens of earlier files of the same range)
    blocks: for every 128 ids  u32 minimum | u8 width | u8 exceptions | packed words | positions (u8) | high parts (u32)
    document table: i64 doc_id | u8 present | u32 n_tokens, column by column
    block index: u32 start of every block, from the first block
    u32 range number | u64 offset of the document table | 4 closing bytes

A block's ids less its minimum are packed at the width that holds the given percentile of them; ids that need more
bits keep their low bits in place and their high part in the block's exception list. Ids are read from any block on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

BLOCK = 128
HEAD = struct.Struct("<4sIQQ")
TAIL = struct.Struct("<IQ")
CLOSING = b"\xb6PFB"
#: Ids that one file holds before the next begins (about 32 MB packed); a longer document has a file of its own.
FILE_TOKENS = 16_000_000
#: Ids that are packed at once, whole blocks.
PACKED_AT_ONCE = BLOCK << 11
#: Slots in one of the two generations of a worker's table of pieces, half of them in use at most; longest piece that it holds.
CACHE_SLOTS, LONGEST = 1 << 20, 23
#: Masks of the first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

FIELDS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def bit_width(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Packed blocks of ids and the start of each; a last short block is filled with its minimum."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint64)
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * BLOCK :].min()
    v = full.reshape(blocks, BLOCK)
    low = v.min(axis=1)
    v = (v - low[:, None]).astype(np.uint32)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = bit_width(np.partition(v, at, axis=1)[:, at])
    over = v > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_over = over.sum(axis=1)
    sizes = 6 + width * (BLOCK // 8) + 5 * n_over
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)
    begin = starts[:-1]
    out[begin[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[begin + 4], out[begin + 5] = width, n_over
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            part = (v[rows] & np.uint32((1 << int(w)) - 1)).T.astype(np.uint64)
            packed = np.zeros((2 * w + 1, len(rows)), np.uint64)
            for i in range(BLOCK):
                word, shift = divmod(i * int(w), 64)
                packed[word] |= part[i] << np.uint64(shift)
                if shift + w > 64:
                    packed[word + 1] |= part[i] >> np.uint64(64 - shift)
            out[(begin[rows] + 6)[:, None] + np.arange(16 * w)] = packed[: 2 * w].T.astype("<u8").copy().view(np.uint8).reshape(len(rows), -1)
    b, i = np.nonzero(over)
    if len(b):
        nth = np.arange(len(b)) - np.concatenate(([0], np.cumsum(n_over)[:-1]))[b]
        base = begin[b] + 6 + width[b] * (BLOCK // 8)
        out[base + nth] = i
        out[(base + n_over[b] + 4 * nth)[:, None] + np.arange(4)] = (v[b, i].astype(np.uint64) >> width[b].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), begin.astype(np.uint32)


def unpack_blocks(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of blocks at ``starts`` of ``data`` (bytes)."""
    if not n:
        return np.zeros(0, np.uint32)
    begin = starts.astype(np.int64)
    low = data[begin[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.uint64)
    width, n_over = data[begin + 4].astype(np.int64), data[begin + 5].astype(np.int64)
    v = np.zeros((len(begin), BLOCK), np.uint64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = data[(begin[rows] + 6)[:, None] + np.arange(16 * w)].copy().view("<u8").reshape(len(rows), -1).T.copy()
            mask = np.uint64((1 << int(w)) - 1)
            part = np.empty((BLOCK, len(rows)), np.uint64)
            for i in range(BLOCK):
                word, shift = divmod(i * int(w), 64)
                x = packed[word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | packed[word + 1] << np.uint64(64 - shift)
                part[i] = x & mask
            v[rows] = part.T
    b = np.repeat(np.arange(len(begin)), n_over)
    if len(b):
        nth = np.arange(len(b)) - np.concatenate(([0], np.cumsum(n_over)[:-1]))[b]
        base = begin[b] + 6 + width[b] * (BLOCK // 8)
        high = data[(base + n_over[b] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.uint64)
        v[b, data[base + nth]] |= high << width[b].astype(np.uint64)
    return (v + low[:, None]).reshape(-1)[:n].astype(np.uint32)


class FileBuilder:
    """A file's bytes, but for the closing ones, from documents that come one after another; whole blocks are packed at once."""

    def __init__(self, percentile: float):
        self.percentile, self.doc_ids, self.lengths, self.held = percentile, [], [], 0
        self.packed, self.starts, self.size = [], [], 0
        self.waiting, self.n_waiting = [], 0

    def add(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lengths += lengths
        self.held += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= PACKED_AT_ONCE:
            self._pack(self.n_waiting // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.uint32)])
        for a in range(0, n, PACKED_AT_ONCE):
            packed, begin = pack_blocks(ids[a : min(a + PACKED_AT_ONCE, n)], self.percentile)
            self.packed.append(packed)
            self.starts.append((begin.astype(np.int64) + self.size).astype("<u4"))
            self.size += len(packed)
            if self.size >= 1 << 32:
                raise ValueError("a file's blocks must stay below 4 GiB")
        self.waiting, self.n_waiting = [ids[n:].copy()], len(ids) - n

    def finish(self, range_no: int, before: int) -> bytes:
        self._pack(self.n_waiting)
        table = np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array([x is not None for x in self.doc_ids], np.uint8).tobytes() + np.array(self.lengths, "<u4").tobytes()
        return b"".join([HEAD.pack(b"PFB1", len(self.doc_ids), self.held, before), *self.packed, table, *[x.tobytes() for x in self.starts], TAIL.pack(range_no, HEAD.size + self.size)])


class File:
    """An opened file: number of its range, tokens before it, doc ids and lengths; ids are unpacked some blocks at a time."""

    def __init__(self, content):
        size = len(content)
        magic, n_docs, self.n_tokens, self.before = HEAD.unpack_from(content)
        if magic != b"PFB1" or bytes(content[size - 4 :]) != CLOSING:
            raise ValueError("not a file of token blocks, or cut short")
        self.range_no, at = TAIL.unpack_from(content, size - 4 - TAIL.size)
        raw = np.frombuffer(content, np.uint8)
        present = raw[at + 8 * n_docs : at + 9 * n_docs]
        self.doc_ids = [int(x) if p else None for x, p in zip(np.frombuffer(content, "<i8", n_docs, at), present, strict=True)]
        self.lengths = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs)
        self.starts = np.frombuffer(content, "<u4", -(-self.n_tokens // BLOCK), at + 13 * n_docs)
        self.blocks = raw[HEAD.size : at]

    def parts(self) -> Iterator[np.ndarray]:
        """All ids in order, PACKED_AT_ONCE at a time."""
        for a in range(0, self.n_tokens, PACKED_AT_ONCE):
            b = a // BLOCK
            yield unpack_blocks(self.blocks, self.starts[b : b + PACKED_AT_ONCE // BLOCK], min(PACKED_AT_ONCE, self.n_tokens - a))

    def checksums(self) -> list[int]:
        """The crc32 of each document's ids as little-endian unsigned 32-bit integers."""
        ends = np.cumsum(self.lengths, dtype=np.int64).tolist()
        out, crc, at = [], 0, 0
        for ids in self.parts():
            raw = memoryview(ids.astype("<u4").tobytes())
            done, to = 0, at + len(ids)
            while len(out) < len(ends) and ends[len(out)] <= to:
                end = ends[len(out)] - at
                out.append(zlib.crc32(raw[4 * done : 4 * end], crc))
                crc, done = 0, end
            crc = zlib.crc32(raw[4 * done :], crc)
            at = to
        return out + [0] * (len(ends) - len(out))


def _classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = SPACE
    t[33:48] = t[58:65] = t[91:97] = t[123:127] = SIGN
    t[65:91] = t[97:123] = LETTER
    t[48:58] = DIGIT
    t[ord("'")] = APOSTROPHE
    return t


#: Classes of bytes; 0 are controls and bytes beyond ASCII, of which nothing is assumed but for the letters of U+00C0 to U+00FF.
SPACE, SIGN, LETTER, DIGIT, APOSTROPHE = 1, 2, 3, 4, 5
CLASS = _classes()
#: Class pairs between which a byte-level pre-tokenizer always cuts, whatever stands around them.
CUT = np.zeros((8, 8), bool)
for _one, _two in ((LETTER, SIGN), (LETTER, APOSTROPHE), (LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, SIGN), (DIGIT, APOSTROPHE), (SIGN, LETTER), (SIGN, DIGIT), (LETTER, SPACE), (DIGIT, SPACE), (SIGN, SPACE), (APOSTROPHE, SPACE)):
    CUT[_one, _two] = True
CUT = CUT.reshape(-1)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: at each text, between the class pairs of CUT, and after a line feed on its own.

    A run of white space is never cut, nor parted from what follows it, as the pre-tokenizer looks ahead from there.
    """
    c = CLASS[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]  # two signs
    c[at] = c[at + 1] = LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = CUT[c[:-1] << 3 | c[1:]]
    feed = np.flatnonzero(data[1:-1] == 10) + 1
    feed = feed[(c[feed - 1] >= SIGN) & (c[feed + 1] >= SIGN)]
    cut[feed + 1] = True
    first = offsets[:-1]
    cut[first[first < len(data)]] = True
    return np.flatnonzero(cut)


class PieceTable:
    """Ids of pieces of up to 23 bytes by their exact bytes: a hash table of bounded size, probed for many at once."""

    def __init__(self, slots: int = CACHE_SLOTS):
        self.keys = np.zeros((3, slots), np.uint64)
        self.place, self.count = np.full(slots, -1, np.int32), np.zeros(slots, np.uint8)
        self.ids, self.used, self.entries = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        mask = len(self.place) - 1
        out = np.full(len(hashes), -1, np.int64)
        live, slot = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(live):
            same = (self.keys[0, slot] == keys[0, live]) & (self.keys[1, slot] == keys[1, live]) & (self.keys[2, slot] == keys[2, live])
            out[live[same]] = slot[same]
            on = ~same & (self.place[slot] >= 0)
            live, slot = live[on], slot[on] + 1 & mask
        return out

    def insert(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys that are not in the table, with their ids one after another."""
        mask, starts = len(self.place) - 1, np.cumsum(counts) - counts + self.used
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used, self.entries = self.used + len(ids), self.entries + len(counts)
        live, slot = np.arange(len(hashes)), (hashes & np.uint64(mask)).astype(np.int64)
        while len(live):
            free = np.flatnonzero(self.place[slot] < 0)
            mine, first = np.unique(slot[free], return_index=True)
            who = live[free[first]]
            self.keys[:, mine], self.place[mine], self.count[mine] = keys[:, who], starts[who], counts[who]
            on = np.ones(len(live), bool)
            on[free[first]] = False
            live, slot = live[on], slot[on] + 1 & mask


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece about once.

    A byte-level pre-tokenizer cuts texts at the places of ``piece_starts`` in any case, so a text's ids are those of its
    pieces. New pieces are encoded many at once, a line each: the line feed's id parts them again. The table has two
    generations of bounded size, so pieces in use survive when one is dropped. Long pieces, texts that hold an added
    token, and all texts of tokenizers of another kind go to the library as they are.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table, self.older = Tokenizer.from_file(path), PieceTable(), None
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.added = [t["content"].encode() for t in kind.get("added_tokens") or []]
        self.plain = re.compile(r" ?\S+").fullmatch
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and their numbers."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if self.plain(p)] if self.line is not None else []
        groups = [plain[a : a + 1000] for a in range(0, len(plain), 1000)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([pieces[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) == len(some):
                for k, a, b in zip(some, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                    out[k] = ids[a:b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.whole([pieces[k] for k in rest]), strict=True):
            out[k] = ids
        return np.concatenate(out), np.array([len(x) for x in out], np.int32)

    def _slots(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The table's slots of pieces of up to LONGEST bytes; unknown ones are encoded."""
        wide = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.empty((3, len(starts)), np.uint64)
        for k in range(3):
            held = np.clip(sizes - 8 * k, 0, 8).astype(np.uint64)
            keys[k] = wide[starts + 8 * k] & FIRST_BYTES[held]
        keys[2] |= sizes.astype(np.uint64) << np.uint64(56)
        hashes = textbytes.mix(textbytes.mix(keys[0] + keys[1] * np.uint64(0x9E3779B97F4A7C15)) ^ keys[2])
        slots = self.table.find(keys, hashes)
        while len(lost := np.flatnonzero(slots < 0)):
            _, first = np.unique(hashes[lost], return_index=True)
            new = lost[first]
            if self.table.entries + len(new) > len(self.table.place) // 2 and self.table.entries:
                self.table, self.older = PieceTable(), self.table
                slots = self.table.find(keys, hashes)
                continue
            if self.older is not None:
                at = self.older.find(keys[:, new], hashes[new])
                known, at = new[at >= 0], at[at >= 0]
                counts = self.older.count[at]
                self.table.insert(keys[:, known], hashes[known], self.older.ids[runs(self.older.place[at], counts)], counts)
                new = np.setdiff1d(new, known, assume_unique=True)
            if len(new):
                raw = [data[a:b].tobytes().decode() for a, b in zip(starts[new].tolist(), (starts[new] + sizes[new]).tolist(), strict=True)]
                self.table.insert(keys[:, new], hashes[new], *self.lines(raw))
            slots[lost] = self.table.find(keys[:, lost], hashes[lost])
        return slots

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(data, offsets)
        sizes = np.diff(np.append(starts, len(data)))
        short = sizes <= LONGEST
        padded = np.concatenate((data, np.zeros(32, np.uint8)))
        held = np.flatnonzero(short)
        place, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        # a step holds fewer pieces than a table, so none of its slots is dropped meanwhile
        parts = []
        for a in range(0, len(held), len(self.table.place) // 4):
            some = held[a : a + len(self.table.place) // 4]
            slots = self._slots(padded, starts[some], sizes[some])
            counts[some] = self.table.count[slots]
            parts.append(self.table.ids[runs(self.table.place[slots], counts[some])])
        place[held] = np.cumsum(counts[held]) - counts[held]
        at = sum(map(len, parts))
        long = np.flatnonzero(~short)
        if len(long):
            texts = [data[a:b].tobytes() for a, b in zip(starts[long].tolist(), (starts[long] + sizes[long]).tolist(), strict=True)]
            distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            ids = self.whole([t.decode() for t in distinct])
            ends = np.cumsum([len(x) for x in ids])
            which = np.array([distinct[t] for t in texts])
            counts[long] = np.array([len(x) for x in ids])[which]
            place[long] = ends[which] - counts[long] + at
            parts += ids
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        out = every[runs(place, counts)] if len(long) else every
        run = np.concatenate(([0], np.cumsum(counts)))
        return out, np.diff(run[np.searchsorted(starts, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; ``data``: UTF-8 bytes, ``offsets``: one more than texts."""
        raw = data.tobytes()
        if self.cuts and not any(t in raw for t in self.added):
            return self._pieces(data, offsets)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if self.cuts and not any(t in raw[a:b] for t in self.added):
                out.append(self._pieces(data[a:b], np.array([0, b - a]))[0])
            else:
                out += self.whole([raw[a:b].decode()])
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.array([len(x) for x in out], np.int64)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    counts = counts.astype(np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _packer(tokenizer: str | Callable[[], str], end_id: int | None, percentile: float, file_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer() if callable(tokenizer) else tokenizer)
        number, before, file = TaskContext.get().partitionId(), 0, FileBuilder(percentile)

        def flush() -> pa.RecordBatch:
            nonlocal file, before
            content = file.finish(number, before)
            before, file = before + file.held, FileBuilder(percentile)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            data, offsets = common.string_buffers(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in common.row_chunks(offsets):
                ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends, lengths = np.cumsum(counts).tolist(), counts.tolist()
                taken = at = 0
                for k, n in enumerate(lengths):
                    if (file.held + ends[k] - at > file_tokens) and (file.held or k > taken):
                        to = ends[k] - n
                        file.add(names[a + taken : a + k], lengths[taken:k], ids[at:to])
                        yield flush()
                        taken, at = k, to
                file.add(names[a + taken : b], lengths[taken:], ids[at:])
        if file.doc_ids:
            yield flush()

    return pack


def write_token_files(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int | None = 2, percentile: float = 0.9, partitions: int | None = None, file_tokens: int = FILE_TOKENS) -> str:
    """Encode every whole text (null: empty) and write the ids in ascending order of doc_id (null first, ties in any order).

    ``docs``: doc_id long, text string; other columns are not read, whatever their names. Repeated rows are written each.
    A text of any length that Spark holds is encoded whole, and lies in a file of its own from ``file_tokens`` ids on. An
    empty table gives a folder without files. ``tokenizer``: the file, or a function that gives
    its place on the executor. ``end_id`` closes each document (None: no end id). Rows are dealt by ranges of doc_id,
    so files follow each other in the order of their range number. Returns the folder.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sort = narrow.repartitionByRange(partitions, "doc_id") if partitions else narrow.repartitionByRange("doc_id")
    return common.write_files(sort.sortWithinPartitions("doc_id").mapInArrow(_packer(tokenizer, end_id, percentile, file_tokens), "content binary"), CLOSING, "token-blocks")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            file = File(content.as_buffer())
            n, lengths = len(file.doc_ids), file.lengths.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, file.range_no, np.int32)), pa.array(file.doc_ids, pa.int64()), pa.array(np.cumsum(lengths) - lengths + file.before), pa.array(lengths), pa.array(file.checksums(), pa.int64()), pa.array([path] * n)],
                names=["range_no", "doc_id", "start", "n_tokens", "ids_crc32", "file"],
            )


def read_token_files(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file.

    Files are read once; their rows are kept as a narrow table, whose totals by range give each range's start. Ranges
    number at most as many as the shuffle had partitions; only one total for each reaches the driver. No files, no rows.
    """
    rows = common.materialize(common.read_files(spark, path).mapInArrow(_open, "range_no int, doc_id long, start long, n_tokens long, ids_crc32 long, file string"), "token-rows")
    totals = {r.range_no: r.n for r in rows.groupBy("range_no").agg(F.sum("n_tokens").alias("n")).collect()}
    at, begins = 0, []
    for k in sorted(totals):
        begins.append((k, at))
        at += totals[k]
    before = F.broadcast(spark.createDataFrame(begins, "range_no int, before long"))
    return rows.join(before, "range_no").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file")
