"""What both vector searches share: usable rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, nonzero: bool, vector: str = "embedding", identifier: str = "vec_id") -> DataFrame:
    """row long, vec_id long, v array<double>: rows with an id and a vector without null or non-finite components.

    Vectors of another length than the most frequent one (ties: the longer) take no part either, as nothing is defined
    between them and the others, nor do empty ones; ``nonzero`` leaves out zero vectors too. ``row`` tells rows of one id
    apart; it is fixed once the result is written.
    """
    v = F.col(vector).cast("array<double>")
    some = rows.select(F.col(identifier).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = some.where(finite)
    if nonzero:
        some = some.where(F.exists("v", lambda x: x != 0))
    length = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    some = some.where(F.size("v") == (length[0].n if length else 0))
    return some.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)

