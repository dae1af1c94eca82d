"""The data source ``image_frames``: a row a frame, page or tile of image files, in batch and as a stream, and files from rows.

    spark.dataSource.register(image_files.ImageFrames)
    spark.read.format("image_frames").load(folder)
    spark.read.format("image_frames").schema("path string, frame int, width int, height int").option("parts", True).load(folder)
    spark.readStream.format("image_frames").option("filesPerBatch", 100).load(folder)
    rows.select("name", "content").write.format("image_frames").mode("append").save(folder)

Files are listed once, where the query is planned, and packed into partitions of about ``splitBytes``, in which each counts
OPEN_BYTES more than it has, so that many small files are shared out too; a larger TIFF file is shared out by pages. A task holds one file's bytes (TIFF: one page's or part's) and one image. Only the columns of the schema
given to the reader are made: without ``data`` pages of TIFF files are not decoded. With the option ``pushFilters`` filters on
``frame`` are pushed down (spark.sql.python.filterPushdown.enabled must be set). A file that can't be read gives a row with its error.

Paths are what pyarrow's file systems open (local, hdfs, s3, gs). Stores that only Spark reads go through ``frames_of``, which
takes rows of Spark's binaryFile source instead.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import codecs, sequences

SCHEMA = "path string, format string, frame int, x int, y int, width int, height int, channels int, delay_ms int, data binary, error string"
KINDS = {"path": pa.string(), "format": pa.string(), "error": pa.string(), "data": pa.binary()} | dict.fromkeys(("frame", "x", "y", "width", "height", "channels", "delay_ms"), pa.int32())
SPLIT_BYTES = 64 << 20
#: What a file counts beside its bytes: images are packed many times tighter in files than their pixels are, so decoding small ones takes far longer than reading them.
OPEN_BYTES = 2 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is missing, of this machine, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/pixelweave-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in ns) of the files below a folder, or of one file; names with _ or . in front are left out."""
    files, at = _open(path)
    info = files.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    hidden = lambda name: any(part[:1] in "_." for part in name[len(at) :].split("/") if part)
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and (f.path == at or not hidden(f.path)))


def detected(head: bytes, path: str) -> str | None:
    """The format by leading bytes, else by extension."""
    for name, at, digits in codecs.SIGNATURES:
        sign = bytes.fromhex(digits)
        if head[at : at + len(sign)] == sign:
            return name
    ext = path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else None
    return codecs.EXTENSIONS.get(ext, ext)


def rows_of(path: str, file, columns: list[str], parts: bool, share: tuple[int, int] = (0, 1), frames: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """One batch an image, of the wanted columns; ``frames``: the first and last number that is wanted."""
    kind = detected(file.read(132), path)
    file.seek(0)

    def batch(values: dict) -> pa.RecordBatch:
        values = {"path": path, "format": kind} | values
        return pa.RecordBatch.from_arrays([pa.array([values.get(c)], KINDS[c]) for c in columns], names=columns)

    try:
        for image in sequences.images(kind, file, "data" in columns, parts, share):
            if frames and not frames[0] <= image["frame"] <= frames[1]:
                if image["frame"] > frames[1]:
                    break
                continue
            data = image.pop("data")
            yield batch({**image, "delay_ms": image["delay"], "data": None if data is None else data.astype("<u2").tobytes()})
    except Exception as e:  # noqa: BLE001  a broken file is a row with its error
        yield batch({"error": f"{type(e).__name__}: {e}"})


@dataclass
class Files(InputPartition):
    paths: list[str]
    share: tuple[int, int] = (0, 1)


def planned(files: list[tuple[str, int, int]], split: int) -> list[Files]:
    """Files packed in order up to ``split`` bytes, each with OPEN_BYTES on top; a larger TIFF file is shared by as many partitions as it has splits."""
    out: list[Files] = []
    held, size = [], 0
    for path, n, _ in files:
        if n > split and path.lower().endswith((".tif", ".tiff")):
            ways = -(-n // split)
            out += [Files([path], (k, ways)) for k in range(ways)]
            continue
        if held and size + n + OPEN_BYTES > split:
            out.append(Files(held))
            held, size = [], 0
        held.append(path)
        size += n + OPEN_BYTES
    return out + ([Files(held)] if held else [])


class _Reads:
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        unknown = set(self.columns) - set(KINDS)
        if unknown:
            raise ValueError(f"image_frames has no columns {sorted(unknown)}")
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.parts, self.wanted = str(options.get("parts", "false")).lower() == "true", None

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            files, at = _open(path)
            with files.open_input_file(at) as file:
                yield from rows_of(path, file, self.columns, self.parts, partition.share, self.wanted)


class Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[Files]:
        return planned(listed(self.path), self.split) or [Files([])]


class Filtering(Batch):
    """Takes filters on ``frame``; Spark allows such a reader only while its setting for them is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        low, high = 0, (1 << 31) - 1
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                v = int(f.value)
                if isinstance(f, EqualTo):
                    low, high = max(low, v), min(high, v)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, v - isinstance(f, LessThan))
                else:
                    low = max(low, v + isinstance(f, GreaterThan))
                self.wanted = (low, high)
            else:
                yield f


class Stream(_Reads, DataSourceStreamReader):
    """Files in order of (modification time, path); the offset is the last one read.

    A file that appears later with an older time is missed. The trigger availableNow reads one batch.
    """

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.most = int(options.get("filesPerBatch", 1000))
        self.last = {"time": -1, "path": ""}

    def _after(self, offset: dict) -> list[tuple[int, str, int]]:
        return sorted((t, p, n) for p, n, t in listed(self.path) if (t, p) > (offset["time"], offset["path"]))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        some = self._after(self.last)[: self.most]
        if some:
            self.last = {"time": some[-1][0], "path": some[-1][1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = max(self.last, end, key=lambda o: (o["time"], o["path"]))
        some = [(p, n, t) for t, p, n in self._after(start) if (t, p) <= (end["time"], end["path"])]
        return planned(some, self.split) or [Files([])]

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are done."""


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Sink(DataSourceWriter):
    """Each row (name, content) as a file: written aside by the tasks, and moved to its name when all are done."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows to write have a name and a content")
        if overwrite:
            raise ValueError("image_frames only appends")
        self.path, self.aside = path, f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        files, at = _open(self.aside)
        mine, names = f"{at}/{uuid.uuid4().hex}", []
        for row in rows:
            if "/" in row["name"] or row["name"][:1] in ("", "_", "."):
                raise ValueError(f"not a file's name: {row['name']!r}")
            files.create_dir(mine, recursive=True)
            with files.open_output_stream(f"{mine}/{row['name']}") as out:
                out.write(bytes(row["content"]))
            names.append(f"{mine}/{row['name']}")
        return Written(names)

    def commit(self, messages) -> None:
        files, at = _open(self.path)
        for message in messages:
            for name in message.names if message else []:
                files.move(name, f"{at}/{name.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, at = _open(self.aside)
        if files.get_file_info(at).type == fs.FileType.Directory:
            files.delete_dir(at)


class ImageFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Batch:
        pushed = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (Filtering if pushed else Batch)(schema, self.options)

    def streamReader(self, schema: StructType) -> Stream:
        return Stream(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Sink:
        return Sink(self.options["path"], schema, overwrite)


def frames_of(files: DataFrame, columns: list[str] | None = None, parts: bool = False) -> DataFrame:
    """The same rows from a table of (path, content), as Spark's binaryFile source gives it from any store."""
    names = columns or list(KINDS)
    names = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from rows_of(path, io.BytesIO(content.as_py()), names, parts)

    return files.select("path", "content").mapInArrow(run, ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in names))


def encoded_sequences(frames: DataFrame, kind: str) -> DataFrame:
    """name, content of one file for each seq_id: its images (seq_id, scene, delay_ms, width, height, channels, data) in order of scene.

    A sequence's images meet in one task, as the file is one stream of bytes; what is grouped are images, not pixels.
    """
    put, ending = sequences.WRITERS[kind], kind.partition("_")[0]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["scene"])
        arrays = [np.frombuffer(r["data"], "<u2").reshape(r["height"], r["width"], r["channels"]).astype(np.int32) for r in rows]
        content = put(arrays, [r["delay_ms"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([f"{key[0].as_py()}.{ending}"]), pa.array([content], pa.binary())], names=["name", "content"])

    cut = frames.select(F.col("seq_id").cast("long"), "scene", "delay_ms", "width", "height", "channels", "data")
    return cut.groupBy("seq_id").applyInArrow(run, "name string, content binary")
