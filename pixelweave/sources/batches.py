"""Steps on Arrow batches: those that follow each other directly share one Python process a core."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def follow(df: DataFrame, columns: Sequence[str], run: Step, schema: str) -> DataFrame:
    """``columns`` of ``df`` through a step, as by ``mapInArrow``.

    Where ``df`` is the result of another step, and not cached, both are one ``mapInArrow``: a chain of steps has one process a
    core, not one a step. A step takes its columns by name, in batches of any number of rows (those of the step before).
    """
    source, whole = df.select(*columns), run
    if "_steps" in vars(df) and not df.is_cached:
        source, first = df._steps

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(first(batches))

    out = source.mapInArrow(whole, schema)
    out._steps = source, whole
    return out
