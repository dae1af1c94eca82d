"""What the operators of this package share: shared folders, tables written and read again, files, null handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel handles at once; its temporary arrays take about 40 times that.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach, below ``spark.checkpoint.dir``.

    Where that setting is missing a folder of this machine serves, but only for a local master (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "pixelweave-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch between the JVM and Python while this package writes its tables; texts may be long.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches hold BATCH_ROWS rows, so that neither side of a task holds many megabytes of text twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tasks a core that write an intermediate table at most; each file of a table costs the file system some calls of its own.
WRITERS_A_CORE = 8


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it again: cuts the lineage, and a lost executor loses nothing of it.

    More partitions than WRITERS_A_CORE for each core of the cluster are read one after another by as many tasks, so that
    small tables of many partitions do not become as many files. Where executors come and go their number says nothing, and
    partitions stay as they are.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        df = df.coalesce(WRITERS_A_CORE * spark.sparkContext.defaultParallelism)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``materialize`` that nothing reads any more."""
    jvm, at = df.sparkSession._jvm, df.written_to
    jvm.org.apache.hadoop.fs.Path(at).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(at), True)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_of(df: DataFrame, but: Iterable[str] = ()) -> Column:
    """All columns of ``df`` in one, so that none clashes with a name that an operator uses; ``but`` those are left out."""
    taken = {c.lower() for c in but}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def by_hash(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """``most`` of about ``n`` rows, those of least md5 of their key: a bound on the hash leaves few more before they are sorted.

    Rows of one key pass the bound together or not at all. Where it leaves fewer than are due, as with few distinct keys, all
    rows are sorted instead, of which a task keeps ``most`` at a time.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    share = (most + 6 * most**0.5 + 20) / max(n, 1)
    if share < 1:
        bounded = rows.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * 2**32))
        if bounded.limit(most).count() == most:
            rows = bounded
    return rows.orderBy(digest, key).limit(most)


def write_files(files: DataFrame, ending: bytes, name: str) -> str:
    """Write each row's binary ``content`` plus ``ending`` as a file of its own; returns the folder.

    Spark's text writer copies the bytes of a value unchanged and ends each row with its separator; with one
    row a file that gives exact binary files on any file system that Spark reaches, through Spark's output
    committer, so that repeated or lost tasks leave no partial file.
    """
    path = shared_dir(files.sparkSession, name)
    rows = files.select(F.col("content").cast("string").alias("value"))
    with small_batches(files.sparkSession):
        rows.write.option("lineSep", ending.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of an Arrow string or binary column, without a copy."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes together; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def arrow_batches(schema: pa.Schema, columns: Iterable[list]) -> Iterator[pa.RecordBatch]:
    for values in columns:
        yield pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
