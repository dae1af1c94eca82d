"""Approximate nearest neighbours: balanced posting lists behind a graph of centroids.

Centroids are fitted on a bounded sample (SAMPLE rows) by balanced k-means; every row is indexed. A row stands in the
posting list of its nearest centroid, and of others nearly as near (within 1 + BOUNDARY of the least distance). A query
finds near centroids by best-first search in a neighbour graph held in memory, keeps the LEAST_PROBES nearest and those
whose distance is within 1 + RATIO of the least, and reads their lists whole; distances are exact, in double precision. The nearest
of a fixed sample are candidates besides, so a query has k rows wherever the table has k others.

Centroids number at most MOST_LISTS, so the graph that is broadcast has a fixed bound; longer lists and
their queries are cut into blocks by a hash, so no task reads more than about BLOCK of either however the rows cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, usable

SAMPLE = 20_000
#: Rows that a list should hold, most lists, and rows of a block.
LIST_ROWS, MOST_LISTS, BLOCK = 200, 2048, 2048
NEIGHBOURS = 24
BOUNDARY, COPIES = 0.06, 4
RATIO, MOST_PROBES = 0.2, 512
#: A query's nearest lists that are read whatever the ratio: in few dimensions, or beside copies, the least distance is near 0.
LEAST_PROBES = 16
#: Sampled rows whose k nearest are candidates of a query; the k-th bounds its k-th nearest distance from above, so lists give only rows within it.
LIMIT_ROWS = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def fit_centroids(x: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Balanced k-means: a cluster's distance grows with its size while rows are dealt; overfull clusters give a seed to empty ones."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)]
    fair = len(x) / max(k, 1)
    penalty = np.zeros(k)
    for _ in range(rounds):
        owner, spread = np.empty(len(x), np.int64), 0.0
        for a in range(0, len(x), 2048):
            d = squared(x[a : a + 2048], centers)
            spread += d.min(axis=1).sum()
            owner[a : a + 2048] = (d + penalty).argmin(axis=1)
        sizes = np.bincount(owner, minlength=k)
        penalty = np.maximum(penalty + 0.2 * spread / len(x) * (sizes / fair - 1), 0)
        order = np.argsort(owner, kind="stable")
        begin = np.concatenate(([0], np.cumsum(sizes)))
        full = sizes > 0
        sums = np.add.reduceat(x[order], begin[:-1][full], axis=0)
        centers[full] = sums / sizes[full][:, None]
        filled = np.argsort(-sizes, kind="stable")[: int(full.sum())]
        for nth, empty in enumerate(np.flatnonzero(~full)):
            big = filled[nth % len(filled)]
            centers[empty] = x[order[begin[big] + rng.integers(sizes[big])]]
    return centers


@dataclass
class Graph:
    """Centroids and each one's neighbours; searched from fixed entry points outwards."""

    centers: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centers: np.ndarray, neighbours: int = NEIGHBOURS, seed: int = 0) -> Graph:
        n = len(centers)
        k = min(neighbours, n - 1)
        if k < 1:
            return cls(centers, np.zeros((n, 1), np.int64), np.arange(n))
        links = np.empty((n, k + 2), np.int64)
        for a in range(0, n, 1024):
            d = squared(centers[a : a + 1024], centers)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links[a : a + 1024, :k] = np.argsort(d, axis=1, kind="stable")[:, :k]
        # a ring in random order, both ways, makes every centroid reachable
        ring = np.random.default_rng(seed).permutation(n)
        links[ring, k], links[ring, k + 1] = np.roll(ring, 1), np.roll(ring, -1)
        return cls(centers, links, ring[: min(n, 16)])

    def search(self, x: np.ndarray, wanted: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the nearest centroids found of each row, nearest first; all rows take a step at once."""
        n, q = len(self.centers), len(x)
        width, wanted = min(max(width, wanted), n), min(wanted, n)
        norm, own = (self.centers**2).sum(1), (x * x).sum(1)
        seen = np.zeros((q, n), bool)
        ids = np.broadcast_to(self.entries, (q, len(self.entries))).copy()
        near = np.maximum(own[:, None] - 2 * x @ self.centers[self.entries].T + norm[self.entries], 0)
        done = np.zeros(ids.shape, bool)
        seen[:, self.entries] = True
        while True:
            if ids.shape[1] > width:
                keep = np.argpartition(near, width - 1, axis=1)[:, :width]
                ids, near, done = (np.take_along_axis(t, keep, 1) for t in (ids, near, done))
            open_ = np.where(done, np.inf, near)
            best = np.argsort(open_, axis=1)[:, :4]  # the four nearest that are not yet opened, at once
            go = np.take_along_axis(open_, best, 1) < np.inf
            live = np.flatnonzero(go.any(axis=1))
            if not len(live):
                break
            np.put_along_axis(done, best, True, 1)
            opened = np.take_along_axis(ids, best, 1)[live]
            new = self.links[opened].reshape(len(live), -1)
            fresh = ~seen[live[:, None], new] & np.repeat(go[live], self.links.shape[1], axis=1)
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            # an id that stands twice counts at its first place; if that is shut, the id is seen or shut anyway next time
            fresh &= ~twice
            dist = np.full(new.shape, np.inf)
            r, c = np.nonzero(fresh)
            to = new[r, c]
            rows = live[r]
            dist[r, c] = np.maximum(own[rows] - 2 * np.einsum("ij,ij->i", x[rows], self.centers[to]) + norm[to], 0)
            seen[rows, to] = True
            more_ids, more = np.zeros((q, new.shape[1]), np.int64), np.full((q, new.shape[1]), np.inf)
            more_ids[live], more[live] = new, dist
            ids, near, done = np.hstack((ids, more_ids)), np.hstack((near, more)), np.hstack((done, np.isinf(more)))
        order = np.argsort(near, axis=1, kind="stable")[:, :wanted]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(near, order, 1))


def _deal(graph, wanted: int, width: int, ratio: float, least: int = 1):
    """Rows with a vector v → one for each list within 1 + ratio of the least distance, and for the ``least`` nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                ids, near = graph.value.search(matrix(part.column("v")), wanted, width)
                keep = np.isfinite(near) & ((near <= near[:, :1] * (1 + ratio)) | (np.arange(near.shape[1]) < least))
                row, col = np.nonzero(keep)
                at = pa.array(row)
                others = [c for c in part.schema.names if c != "list"]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), *[part.column(c).take(at) for c in others]], names=["list", *others])

    return run


def _limit(some, k: int):
    """Rows of queries with their k nearest in a sample of the rows and the k-th's distance (infinite if there are fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, x = some.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                asks, y = part.column("row").to_numpy(), matrix(part.column("v"))
                d = squared(y, x)
                d[asks[:, None] == rows[None]] = np.inf
                # what rounding may hide is taken in, then distances are exact, as those of the lists
                reach = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(asks), np.inf)
                reach = reach + 1e-12 * ((y * y).sum(axis=1) + (x * x).sum(axis=1).max(initial=0))
                near, limits = [], []
                for ask, row, own, most in zip(asks, d, y, reach, strict=True):
                    at = np.flatnonzero((row <= most) & (rows != ask))
                    far = np.sqrt(((own - x[at]) ** 2).sum(axis=1))
                    top = np.lexsort((ids[at], far))[:k]
                    near.append([{"row": r, "vec_id": i, "score": f} for r, i, f in zip(rows[at[top]].tolist(), ids[at[top]].tolist(), far[top].tolist(), strict=True)])
                    limits.append(far[top[-1]] if len(top) == k else np.inf)
                kind = pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "vec_id", "v")), pa.array(limits, pa.float64()), pa.array(near, kind)], names=["row", "vec_id", "v", "limit", "near"])

    return run


FOUND = "ask long, query_id long, row long, vec_id long, score double"


def _read_lists(k: int):
    def run(key, postings: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(postings) and len(queries):
            rows, ids, x = postings.column("row").to_numpy(), postings.column("vec_id").to_numpy(), matrix(postings.column("v"))
            asks, names, y = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy(), matrix(queries.column("v"))
            limits = queries.column("limit").to_numpy()
            step = max(1, 2_000_000 // max(1, x.size))
            for a in range(0, len(asks), step):
                d = np.sqrt(((y[a : a + step, None, :] - x[None]) ** 2).sum(axis=2))
                for row, ask, name, limit in zip(d, asks[a : a + step], names[a : a + step], limits[a : a + step], strict=True):
                    near = np.flatnonzero((rows != ask) & (row <= limit))
                    top = near[np.lexsort((ids[near], row[near]))[:k]]
                    found.append((np.full(len(top), ask), np.full(len(top), name), rows[top], ids[top], row[top]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(("ask", "query_id", "row", "vec_id", "score"), columns, strict=True)})

    return run


def search(rows: DataFrame, is_query, k: int = 10, ratio: float = RATIO, most_probes: int = MOST_PROBES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found of each query row, nearest first, ties to the smaller id.

    ``rows``: vec_id, embedding; other columns are not read, whatever their names. ``is_query`` is a condition on vec_id.
    Null, zero and non-finite vectors take no part, nor do those of another length than most (``vectors.usable``). A
    query's candidates are all rows but its own: others of its id are candidates, and each row of a repeated query id is
    a query, with ranks of its own. No rows, or no others, give no result. Runs some jobs when called.
    """
    spark = rows.sparkSession
    table = common.materialize(usable(rows, nonzero=True), "ann-rows")
    n = table.count()
    taken = common.by_hash(table, F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string"), F.col("row").cast("string")), n, sample).select("row", "vec_id", "v").toArrow()
    x = matrix(taken.column("v"))
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_lists = int(min(MOST_LISTS, max(1, n // LIST_ROWS), max(1, len(x) // 8)))
    graph = spark.sparkContext.broadcast(Graph.build(fit_centroids(x, n_lists, seed), seed=seed))
    schema = "list int, row long, vec_id long, v array<double>"
    postings = common.materialize(table.mapInArrow(_deal(graph, COPIES, 32, BOUNDARY), schema), "ann-postings")
    some = spark.sparkContext.broadcast((taken.column("row").to_numpy()[:LIMIT_ROWS], taken.column("vec_id").to_numpy()[:LIMIT_ROWS], x[:LIMIT_ROWS].copy()))
    asks = table.where(is_query(F.col("vec_id"))).mapInArrow(_limit(some, k), "row long, vec_id long, v array<double>, limit double, near array<struct<row:long,vec_id:long,score:double>>")
    asks = common.materialize(asks, "ann-asks")
    sampled = asks.select(F.col("row").alias("ask"), F.col("vec_id").alias("query_id"), F.explode("near").alias("n")).select("ask", "query_id", "n.row", "n.vec_id", "n.score")
    asks = common.materialize(asks.select("row", "vec_id", "v", "limit").mapInArrow(_deal(graph, most_probes, most_probes + 32, ratio, LEAST_PROBES), f"{schema}, limit double"), "ann-probes")
    # one row for each list, at most MOST_LISTS: a list's rows meet its queries block by block
    cut = lambda side, name: side.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counted = [tuple(r) for r in cut(postings, "blocks").join(cut(asks, "parts"), "list").collect()]
    blocks = lambda: F.broadcast(spark.createDataFrame(counted, "list int, blocks int, parts int"))
    own = lambda name: F.pmod(F.xxhash64("row"), F.col(name).cast("long")).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    postings = postings.join(blocks(), "list").withColumn("block", own("blocks")).withColumn("part", each("parts")).drop("blocks", "parts")
    asks = asks.join(blocks(), "list").withColumn("part", own("parts")).withColumn("block", each("blocks")).drop("blocks", "parts")
    found = postings.groupBy("list", "block", "part").cogroup(asks.groupBy("list", "block", "part")).applyInArrow(_read_lists(k), FOUND)
    once = found.union(sampled).groupBy("ask", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("ask").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
