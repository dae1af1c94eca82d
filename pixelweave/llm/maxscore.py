"""Exact top-k search by inner product with MaxScore.

Rows are documents, components terms, integer components weights. Shards hold postings by term in blocks of documents.
For a query, terms are sorted by their score bounds; those whose bounds together cannot reach the k-th best score so far are
non-essential: only postings of the essential terms are traversed, and the others are probed, largest bound first, for
documents that are still competitive. The shards' best k are merged. Nothing is approximate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, usable

#: Documents of a shard and of a block in it; queries that a task answers.
SHARD, BLOCK, QUERIES = 4096, 1024, 1024
#: Components from this size on could overflow a 64-bit sum; such rows are reckoned in Python's integers, in shards and parts of their own.
LARGEST = 2.0**27


def integers(w: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's where one is too large."""
    if not w.size or np.abs(w).max() < LARGEST:
        return w.astype(np.int64)
    return np.array([int(x) for x in w.flat], object).reshape(w.shape)


def narrow(w: np.ndarray) -> np.ndarray:
    """The same 64-bit integers in as few bytes as hold them all: shards and queries travel so."""
    kinds = [k for k in (np.int8, np.int16, np.int32) if w.dtype != object and w.size and np.iinfo(k).min <= w.min() and w.max() <= np.iinfo(k).max]
    return w.astype(kinds[0]) if kinds else w


class Shard:
    """Postings of some documents, in blocks: for each term its documents (offsets in the block) and weights, and the weights' range."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, own: np.ndarray | None = None):
        """``own``: what tells rows apart (the ids, where each is one row's)."""
        own = ids if own is None else own
        order = np.lexsort((own, ids))
        self.blocks = []
        for a in range(0, len(ids), BLOCK):
            rows = order[a : a + BLOCK]
            w = narrow(weights[rows])
            postings = []
            for t in range(w.shape[1]):
                at = np.flatnonzero(w[:, t])
                postings.append((at.astype(np.int16), w[at, t]))
            # documents without the term score 0 there
            self.blocks.append((ids[rows], own[rows], postings, w.max(axis=0), w.min(axis=0)))

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, without the query's own row."""
        wide = query.dtype == object or (bool(self.blocks) and self.blocks[0][3].dtype == object)
        kind = object if wide else np.int64
        query = query.astype(kind)
        terms = np.flatnonzero(query)
        best: list[tuple[int, int]] = []
        least = None
        bounds = [np.maximum(query * high.astype(kind, copy=False), query * low.astype(kind, copy=False))[terms] for _, _, _, high, low in self.blocks]
        # blocks that can score highest go first: the k-th best score rises early
        for b in sorted(range(len(self.blocks)), key=lambda b: -int(bounds[b].sum())):
            ids, owners, postings, _, _ = self.blocks[b]
            bound = bounds[b]
            if least is not None and bound.sum() < least:
                break
            order = np.argsort(bound, kind="stable")
            # below a term, the most that all terms of smaller bound add: bounds may be negative where every document has the term
            rest = np.concatenate(([0], np.cumsum(bound[order])))
            essential = 0
            if least is not None:
                positive = np.concatenate(([0], np.cumsum(np.maximum(bound[order], 0))))
                essential = int(np.searchsorted(positive, least, "left")) - 1 if least > 0 else 0
                essential = min(max(essential, 0), len(order))
            score, alive = np.zeros(len(ids), kind), np.zeros(len(ids), bool)
            for j in range(len(order) - 1, essential - 1, -1):
                at, weight = postings[terms[order[j]]]
                score[at] += weight.astype(kind, copy=False) * query[terms[order[j]]]
                alive[at] = True
            if essential == 0:
                alive[:] = True
            docs = np.flatnonzero(alive)
            for j in range(essential - 1, -1, -1):
                if least is not None:
                    docs = docs[score[docs] + rest[j + 1] >= least]
                    if not len(docs):
                        break
                at, weight = postings[terms[order[j]]]
                place = np.searchsorted(at, docs)
                hit = place < len(at)
                hit[hit] = at[place[hit]] == docs[hit]
                score[docs[hit]] += weight[place[hit]].astype(kind, copy=False) * query[terms[order[j]]]
            docs = docs[owners[docs] != own]
            if least is not None:
                docs = docs[score[docs] >= least]
            if len(docs):
                by_id = docs[np.argsort(ids[docs], kind="stable")]
                some = by_id[np.argsort(-score[by_id], kind="stable")[:k]]
                best = sorted([*best, *zip(score[some].tolist(), ids[some].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    least = best[-1][0]
        return best


    def tops(self, queries: np.ndarray, owns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``top`` of many queries at once: place of the query, score and id, best first within a query.

        Postings are gone through once a block for all queries: the essential terms of each add up in one matrix product, and
        the others are probed, largest bound first, for all pairs of a query and a document that are still competitive.
        """
        if queries.dtype == object or (self.blocks and self.blocks[0][3].dtype == object):
            rows = [(q, score, doc) for q, own in enumerate(owns.tolist()) for score, doc in self.top(queries[q], own, k)]
            return tuple(np.array(c, kind) for c, kind in zip(list(zip(*rows, strict=True)) or [(), (), ()], (np.int64, object, np.int64), strict=True))
        queries = queries.astype(np.int64)
        n, terms = queries.shape
        asker, best, docs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        none = np.iinfo(np.int64).min
        least = np.full(n, none)
        bounds = [np.maximum(queries * high.astype(np.int64), queries * low.astype(np.int64)) for _, _, _, high, low in self.blocks]
        for b in sorted(range(len(self.blocks)), key=lambda b: -float(bounds[b].sum(dtype=np.float64))):
            ids, owners, postings, high, low = self.blocks[b]
            some = np.flatnonzero(bounds[b].sum(1) >= least)
            if not len(some):
                continue
            bound, query, limit = bounds[b][some], queries[some], least[some]
            order = np.argsort(bound, 1, kind="stable")
            ranked = np.take_along_axis(bound, order, 1)
            # below a term, the most that all terms of smaller bound add: bounds may be negative where every document has the term
            rest = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(ranked, 1)], 1)
            essential = np.where(limit > 0, (np.cumsum(np.maximum(ranked, 0), 1) < limit[:, None]).sum(1), 0)
            weights = np.zeros((terms, len(ids)), np.int64)
            for t, (at, weight) in enumerate(postings):
                weights[t, at] = weight
            of_essential = query.copy()
            np.put_along_axis(of_essential, order, np.where(np.arange(terms) < essential[:, None], 0, np.take_along_axis(query, order, 1)), 1)
            # whole numbers below 2^53 add up exactly in doubles
            exact = (np.abs(query) @ np.maximum(np.abs(high.astype(np.float64)), np.abs(low.astype(np.float64)))).max() < 2.0**52
            score = (of_essential.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64) if exact else of_essential @ weights
            # a query without k documents so far wants this block's best k, beside its own row
            if len(ids) > k and (limit == none).any():
                fresh = limit == none
                limit[fresh] = np.partition(score[fresh], len(ids) - k - 1, 1)[:, len(ids) - k - 1]
            q, d = np.nonzero(score >= np.where(limit == none, none, limit - np.take_along_axis(rest, essential[:, None], 1)[:, 0])[:, None])
            s, left = score[q, d], essential[q]
            for _ in range(int(essential.max())):
                go = np.flatnonzero(left > 0)
                if not len(go):
                    break
                left[go] -= 1
                t = order[q[go], left[go]]
                s[go] += weights[t, d[go]] * query[q[go], t]
                keep = s + rest[q, left] >= limit[q]
                q, d, s, left = q[keep], d[keep], s[keep], left[keep]
            keep = owners[d] != owns[some[q]]
            asker, best, docs = (np.concatenate(x) for x in ((asker, some[q[keep]]), (best, s[keep]), (docs, ids[d[keep]])))
            sort = np.lexsort((docs, -best, asker))
            rank = np.arange(len(sort)) - np.searchsorted(asker[sort], asker[sort])
            sort, rank = sort[rank < k], rank[rank < k]
            asker, best, docs = asker[sort], best[sort], docs[sort]
            least[asker[rank == k - 1]] = best[rank == k - 1]
        return asker, best, docs


def _index(key, table):
    content = pickle.dumps(Shard(table.column("vec_id").to_numpy(), integers(matrix(table.column("w"))), table.column("row").to_numpy()), protocol=5)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})


def _pack(key, table):
    content = pickle.dumps((table.column("row").to_numpy(), table.column("vec_id").to_numpy(), narrow(integers(matrix(table.column("w"))))), protocol=5)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "queries": pa.array([content], pa.binary())})


def _answer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, packed in zip(batch.column("content"), batch.column("queries"), strict=True):
                shard, (owns, asks, weights) = pickle.loads(content.as_py()), pickle.loads(packed.as_py())
                asker, scores, docs = shard.tops(weights, owns, k)
                scores = pa.array([Decimal(s) for s in scores], pa.decimal128(38, 0)) if scores.dtype == object else pa.array(scores).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(owns[asker]), pa.array(asks[asker]), pa.array(docs), scores], names=["ask", "query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floor(scale * x) of each query row with all other rows.

    Null and non-finite vectors take no part, nor do those of another length than most (``vectors.usable``); vectors of
    any size are reckoned exactly. A query's candidates are all rows but its own: others of its id are candidates, and
    each row of a repeated query id is a query, with ranks of its own. Ties go to the smaller vec_id. Other columns are
    not read, whatever their names; an empty table, or one without other rows, gives no rows. A score among the k that
    64 bits do not hold is an error, as in SQL. Runs some jobs when called. Queries meet all shards in blocks of QUERIES queries and SHARD rows, by a shuffle in which only the queries are repeated.
    """
    spark = rows.sparkSession
    # the floor is 64-bit; a double of 2^53 or more is whole as it is
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    table = usable(rows, nonzero=False).select("row", "vec_id", F.transform("v", lambda x: whole(x * scale)).alias("w"))
    table = table.withColumn("wide", F.exists("w", lambda x: F.abs(x) >= LARGEST))
    table = common.materialize(table, "maxscore-rows")
    asks = table.where(is_query(F.col("vec_id")))
    count = lambda some: (some.where(~F.col("wide")).count(), some.where("wide").count())
    (n, wide_n), (q, wide_q) = count(table), count(asks)
    shards, wide_shards, parts, wide_parts = max(1, -(-n // SHARD)), -(-wide_n // SHARD), max(1, -(-q // QUERIES)), -(-wide_q // QUERIES)
    place = lambda of, wide_of, *seed: F.when(F.col("wide"), of + F.pmod(F.xxhash64("vec_id", "row", *seed), F.lit(max(1, wide_of)))).otherwise(F.pmod(F.xxhash64("vec_id", "row", *seed), F.lit(of)))
    key = place(shards, wide_shards)
    index = common.materialize(table.withColumn("shard", key).groupBy("shard").applyInArrow(_index, "shard long, content binary"), "maxscore-index")
    packed = common.materialize(asks.withColumn("part", place(parts, wide_parts, F.lit(1))).groupBy("part").applyInArrow(_pack, "part long, queries binary"), "maxscore-queries")
    # every shard gets each part of the queries once; no side is small enough to be sent through the driver, whatever Spark expects of it
    cells = 2 * (shards + wide_shards)
    right = packed.select("queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards + wide_shards - 1).cast("long"))).alias("shard"))
    met = index.repartition(cells, "shard").hint("merge").join(right.repartition(cells, "shard"), "shard")
    found = met.select("content", "queries").mapInArrow(_answer(k), "ask long, query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
