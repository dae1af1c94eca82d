"""Merkle dataset manifest: one tree a source over its rows, one over the sources, and a verified path for every row.

A row's leaf is the SHA-256 of its fields with their lengths. In a source, leaves stand by doc_id; every 16 consecutive
nodes are hashed into one until a single node, the subroot, remains; the subroots of all sources are hashed into the root.

Leaves are numbered without a source meeting in one task: rows are sorted across tasks by (source, doc_id, leaf), counted by
task and source, and each number is its place in the task plus what earlier tasks counted. Two jobs follow, both on aligned
blocks of 256 leaves that Spark deals out by (source, block): ``_climb`` hashes each block to its top, and tops are the leaves
of the next, 256 times smaller job until every source has one; ``_walk`` comes down again. It moves the authentication path of
a block from leaf to leaf: for each level a treehash stack builds the next run of nodes while the current one is in use, one
leaf a step, so that a task keeps a few runs (their number is the logarithm of the block) beside the digests of the block
it reads. The path above a block comes with the block as one row and is shared by its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Nodes of a run, levels of a block, and leaves of a block.
FAN = 16
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(run: list[bytes]) -> bytes:
    """H of a run of raw digests, which are hashed as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Treehash:
    """Builds the nodes of one level from leaves pushed one by one; holds less than a run for each level below."""

    def __init__(self, level: int):
        self.level, self.stacks, self.done = level, [[] for _ in range(level)], []

    def push(self, digest: bytes) -> None:
        for stack in self.stacks:
            stack.append(digest)
            if len(stack) < FAN:
                return
            digest = parent(stack)
            stack.clear()
        self.done.append(digest)

    def finish(self) -> list[bytes]:
        """No leaf follows: runs that are not full are hashed as they are."""
        for k, stack in enumerate(self.stacks):
            if stack:
                digest = parent(stack)
                stack.clear()
                if k + 1 < self.level:
                    self.stacks[k + 1].append(digest)
                else:
                    self.done.append(digest)
        return self.done


class Traversal:
    """The runs of nodes around each leaf of a block, leaf after leaf.

    At level h the run of the current leaf is in use while a treehash reads the leaves of the next run, one a step: it is
    complete at the very step that the current run ends.
    """

    def __init__(self, leaf: Callable[[int], bytes], n: int, levels: int):
        self.leaf, self.n, self.at = leaf, n, 0
        self.runs, self.next = [], []
        for h in range(levels):
            first = Treehash(h)
            for i in range(min(FAN ** (h + 1), n)):
                first.push(leaf(i))
            self.runs.append(first.finish())
            self.next.append(Treehash(h))

    def top(self) -> bytes:
        return parent(self.runs[-1]) if self.runs else self.leaf(0)

    def path(self) -> list[tuple[list[bytes], int]]:
        """(run, place of the node on the way up in it) by level."""
        return [(run, self.at // FAN**h % FAN) for h, run in enumerate(self.runs)]

    def advance(self) -> None:
        for h, ahead in enumerate(self.next):
            span = FAN ** (h + 1)
            if self.at + span < self.n:
                ahead.push(self.leaf(self.at + span))
            if (self.at + 1) % span == 0 and self.at + 1 < self.n:
                self.runs[h], self.next[h] = ahead.finish(), Treehash(h)
        self.at += 1


def pack(path: list[tuple[list[bytes], int]]) -> bytes:
    """Levels as bytes: size of the run, place in it, the digests of the others."""
    return b"".join(bytes((len(run), at)) + b"".join(run[:at]) + b"".join(run[at + 1 :]) for run, at in path)


def unpack(path: bytes) -> list[tuple[bytes, bytes]]:
    """Of each level the hexadecimal text of the siblings to the left and to the right."""
    out, k = [], 0
    while k < len(path):
        size, at = path[k], path[k + 1]
        left, right = k + 2 + 32 * at, k + 2 + 32 * (size - 1)
        out.append((path[k + 2 : left].hex().encode(), path[left:right].hex().encode()))
        k = right
    return out


def fold(digest: bytes, levels: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in levels:
        digest = hashlib.sha256(left + digest.hex().encode() + right).digest()
    return digest


def leaf_of(fields: list[Column]) -> Column:
    """Hexadecimal SHA-256 of each field as ``-`` (null) or its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (written by ``materialize``, with a column g, never null) with pos, the place within g in the given order, and n, the rows of g.

    ``rows`` is deleted when its numbered form is written.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part int, k long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for batch in batches:
            places = []
            for g in batch.column("g").to_pylist():
                k = k + 1 if g == last else 0
                last = g
                places.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "k"])

    # the number of the range, not of the task: ``materialize`` may let one task go through several ranges
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("part", F.spark_partition_id()).mapInArrow(count, schema)
    dealt = common.materialize(dealt, name)
    # one row for each source and task that holds some of it
    counts = common.materialize(dealt.groupBy("g", "part").agg(F.count("*").alias("c")), f"{name}-counts")
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("g", "part", before.alias("start"), F.sum("c").over(whole).alias("n"))
    out = dealt.join(starts, ["g", "part"]).withColumn("pos", F.col("start") + F.col("k")).drop("part", "k", "start")
    out = common.materialize(out, name)
    for done in (rows, dealt, counts):
        common.discard(done)
    return out


NODES = "g string, pos long, n long, d binary"


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[dict]]]:
    """(path row, leaf rows) of each block of a partition sorted by (g, block, pos); the path row has pos -1."""
    key, above, rows = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["g"], row["block"]) != key:
                if rows:
                    yield above, rows
                key, above, rows = (row["g"], row["block"]), None, []
            if row["pos"] < 0:
                above = row
            else:
                rows.append(row)
    if rows:
        yield above, rows


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _climb(nodes: DataFrame) -> DataFrame:
    """The top of each block as a node; a source that has one node keeps it."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _by_block(batches):
            n = rows[0]["n"]
            top = Treehash(min(BLOCK_LEVELS, height(n)))
            for row in rows:
                top.push(row["d"])
            out.append((rows[0]["g"], rows[0]["block"], -(-n // BLOCK), top.finish()[0]))
            if len(out) >= common.BATCH_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "pos", "n", "d"])

    return _sorted(nodes.select("g", "pos", "n", "d", _block().alias("block"))).mapInArrow(tops, NODES)


def _walk(nodes: DataFrame, paths: DataFrame, emit: Callable[[list[tuple[dict, list, dict]]], pa.RecordBatch], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``emit`` gets (row, path in its block, path row of the block) of every node, some hundreds at a time.

    ``paths`` has (g, pos, sub, path): the path above block ``pos`` of source ``g``, and the source's subroot.
    """
    leaves = nodes.select("g", "pos", "n", "d", *more, _block().alias("block"), F.lit(None).cast("binary").alias("sub"), F.lit(None).cast("binary").alias("path"))
    above = paths.select("g", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("d"), *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in more], F.col("pos").alias("block"), "sub", "path")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[dict, list, dict]] = []
        for top, rows in _by_block(batches):
            way = Traversal(lambda i, rows=rows: rows[i]["d"], len(rows), min(BLOCK_LEVELS, height(rows[0]["n"])))
            for row in rows:
                out.append((row, way.path(), top))
                way.advance()
                if len(out) >= BLOCK:
                    yield emit(out)
                    out = []
        if out:
            yield emit(out)

    return _sorted(leaves.union(above)).mapInArrow(walk, schema)


PATHS = "g string, pos long, sub binary, path binary"


def _path_rows(rows: list[tuple[dict, list, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r["g"] for r, _, _ in rows]), pa.array([r["pos"] for r, _, _ in rows], pa.int64()), pa.array([t["sub"] for _, _, t in rows], pa.binary()), pa.array([pack(p) + t["path"] for _, p, t in rows], pa.binary())],
        names=["g", "pos", "sub", "path"],
    )


class Forest:
    """Trees of all g over numbered nodes: ``tops`` has the last node of each, ``down`` leads paths from the tops to the blocks of leaves."""

    def __init__(self, leaves: DataFrame):
        self.levels = [leaves]
        while True:
            self.levels.append(common.materialize(_climb(self.levels[-1]), "merkle-nodes"))
            if (self.levels[-1].agg(F.max("n").alias("n")).first().n or 1) <= 1:
                break
        self.tops = self.levels[-1]

    def down(self, paths: DataFrame) -> DataFrame:
        """Paths (g, pos, sub, path) of the blocks of leaves, from those of the tops."""
        for nodes in self.levels[-2:0:-1]:
            done, paths = paths, common.materialize(_walk(nodes, paths, _path_rows, PATHS), "merkle-paths")
            if hasattr(done, "written_to"):
                common.discard(done)
        return paths

    def discard(self) -> None:
        for nodes in self.levels[1:]:
            common.discard(nodes)


OUTPUTS = ("mk_leaf", "mk_subroot", "mk_root", "mk_proof_sha256", "mk_folded_root", "mk_verified", "mk_proof")
MANIFEST = "row bigint, doc_id bigint, mk_leaf string, mk_subroot string, mk_root string, mk_proof_sha256 string, mk_folded_root string, mk_verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None, proofs: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, mk_leaf, mk_subroot, mk_root, mk_proof_sha256, mk_folded_root, mk_verified.

    ``tampered`` is the text as it is at verification (a column of ``docs``; default: unchanged): the leaf is computed again
    with it and folded with the original siblings; mk_verified tells whether the root comes out. With ``proofs`` the column
    mk_proof has the path itself, as ``unpack`` reads it.

    Reads doc_id, source, lang, n_chars and text, whole texts of any length; nulls in any of them count as ``-``, a null
    source is a source of its own and comes first, as does a null doc_id in its source. Rows of one doc_id stand by leaf, so
    repeated rows are equal leaves beside each other and get places of their own. An empty table gives no rows. Other
    columns are not read, whatever their names. Runs its jobs when called.
    """
    spark = docs.sparkSession
    fields = [F.col(c) for c in FIELDS]
    changed = F.lit(None).cast("binary") if tampered is None else F.unhex(F.when(tampered.eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf_of([*fields[:-1], tampered])))
    # a null source is "", any other is "s" and its name: in bytewise order, and never null
    g = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_of(fields)).alias("d"), changed.alias("t"))
    leaves = common.materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    numbered = _numbered(leaves, ["doc_id", "d", "row"], "merkle-order")
    forest = Forest(numbered)
    sources = forest.tops.select(F.lit("").alias("g"), F.col("g").alias("source"), "d")
    sources = _numbered(common.materialize(sources, "merkle-sources"), ["source"], "merkle-subroots")
    upper = Forest(sources.select("g", "pos", "n", "d"))
    top = upper.tops.first()
    root = top.d if top else b""
    start = upper.tops.select("g", "pos", F.col("d").alias("sub"), F.lit(b"").alias("path"))
    of_source = _walk(sources, upper.down(start), _source_rows, PATHS, ("source",))
    paths = forest.down(common.materialize(of_source, "merkle-source-paths"))
    forest.discard()
    schema = MANIFEST + (", mk_proof binary" if proofs else "")
    return _walk(numbered, paths, _manifest_rows(root, proofs), schema, ("doc_id", "t", "row")).drop("row")


def _source_rows(rows: list[tuple[dict, list, dict]]) -> pa.RecordBatch:
    """The path above the subroot of each source."""
    return pa.RecordBatch.from_arrays(
        [pa.array([r["source"] for r, _, _ in rows]), pa.array([0] * len(rows), pa.int64()), pa.array([r["d"] for r, _, _ in rows], pa.binary()), pa.array([pack(p) + t["path"] for _, p, t in rows], pa.binary())],
        names=["g", "pos", "sub", "path"],
    )


def _manifest_rows(root: bytes, proofs: bool):
    def emit(rows: list[tuple[dict, list, dict]]) -> pa.RecordBatch:
        last, shared = None, []
        columns: list[list] = [[] for _ in range(9 if proofs else 8)]
        for row, path, top in rows:
            if top is not last:
                last, shared = top, unpack(top["path"])
            packed = pack(path)
            levels = unpack(packed) + shared
            proof = hashlib.sha256(b"".join(left + right for left, right in levels)).hexdigest()
            folded = fold(row["t"] or row["d"], levels)
            values = [row["row"], row["doc_id"], row["d"].hex(), top["sub"].hex(), root.hex(), proof, folded.hex(), folded == root]
            for column, value in zip(columns, values + [packed + top["path"]] * proofs, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_()] + [pa.binary()] * proofs
        names = ["row", "doc_id", *OUTPUTS[:6]] + ["mk_proof"] * proofs
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=names)

    return emit
