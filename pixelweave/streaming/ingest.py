"""Streams of image files and of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.codecs import decode

FILES = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New image files of a folder, decoded as they arrive; point operators apply to it as to a table."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return decode(files.select(F.xxhash64("path").alias("image_id"), "path", "content"))


def event_density(events: DataFrame, late: str = "1 hour", cell: str = "1 hour") -> DataFrame:
    """A density image of (user, time cell) as a windowed count with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", cell), F.col("user_id").alias("y")).agg(F.count("*").alias("n"))


def distinct_images(images: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Images whose exact hash hasn't been seen within the watermark."""
    return images.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])


def replay(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Frames (seq_id, scene, x, y, w, h, data, dispose) as full canvases, with the canvas as state between batches.

    ``data``: RGBA, 16-bit little-endian. Frames of a sequence must arrive in order of scene across batches.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        canvas = np.frombuffer(state.get[0], "<u2").reshape(height, width, 4).copy() if state.exists else np.zeros((height, width, 4), "<u2")
        out = []
        for f in pd.concat(list(batches)).sort_values("scene").itertuples():
            saved = canvas.copy()
            part = np.frombuffer(f.data, "<u2").reshape(f.h, f.w, 4)
            window = canvas[max(f.y, 0) : f.y + f.h, max(f.x, 0) : f.x + f.w]
            part = part[max(-f.y, 0) :, max(-f.x, 0) :][: window.shape[0], : window.shape[1]]
            seen = part[:, :, 3] > 0
            window[seen] = part[seen]
            out.append((key[0], f.scene, canvas.tobytes()))
            if f.dispose == "background":
                window[seen] = 0
            elif f.dispose == "previous":
                canvas = saved
        state.update((canvas.tobytes(),))
        yield pd.DataFrame(out, columns=["seq_id", "scene", "data"])

    return frames.groupBy("seq_id").applyInPandasWithState(run, "seq_id long, scene int, data binary", "canvas binary", "append", GroupStateTimeout.NoTimeout)


