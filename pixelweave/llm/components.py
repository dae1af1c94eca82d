"""Connected components of a table of edges, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); the label is the least node of its component.

    Alternates the two star steps: every node's larger neighbours are linked to its least neighbour, then all its
    smaller neighbours are. Neighbours are never gathered: the least one is an aggregate, joined back to the edges,
    where adaptive execution splits the rows of a node with very many. Ends when a round leaves the edges as they were.
    """
    edges = common.materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large.a == least.u).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        done, edges = edges, common.materialize(small, "components")
        common.discard(done)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == mark:
            break
        mark = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = common.materialize(labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct(), "labels")
    common.discard(edges)
    return out
