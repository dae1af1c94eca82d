"""Steps on Arrow batches that follow each other run in one Python process a core."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave import catalog
from pixelweave.operators import frames
from pixelweave.sources import codecs


def python_steps(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"MapInArrow|FlatMapGroupsInPandas", plan))


@pytest.mark.parametrize(
    ("name", "steps"),
    # files are made of groups, and their format is told by the JVM
    [*[(f"codec_{k}", 2) for k in ("jpeg", "jpeg_progressive", "tensor", "fits")], *[(k, 1) for k in ("synthesize_texture", "shear", "remap", "quantize_dithered", "liquify", "deskew")]],
)
def test_a_query_has_few_python_steps(spark, sf, name, steps):
    assert python_steps(catalog.queries()[name](spark, sf)) == steps


def test_steps_in_one_process_give_what_they_give_apart(spark):
    images = frames.made(spark, 7, 20, 12, 3)
    apart = frames.apply(frames.apply(images.select("*"), lambda p: p // 2).select("*"), lambda p: p[::-1] + 1)
    whole = frames.apply(frames.apply(images, lambda p: p // 2), lambda p: p[::-1] + 1)
    assert python_steps(apart) == 3
    assert python_steps(whole) == 1
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect()))
    # a step taken twice goes on twice, on its own
    other = frames.apply(whole, lambda p: p * 0)
    assert {bytes(r.data) for r in other.collect()} == {bytes(20 * 12 * 6)}
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, apart.collect()))


def test_a_cached_step_is_not_taken_again(spark):
    images = frames.made(spark, 3, 4, 4).cache()
    assert "InMemoryTableScan" in frames.apply(images, lambda p: p)._jdf.queryExecution().executedPlan().toString()
    images.unpersist()


def test_stacks_still_go_together(spark):
    sizes = frames.apply_stacks(frames.made(spark, 6, 4, 4, 1), lambda s: np.full_like(s, len(s)))
    assert {int(np.frombuffer(r.data, "<u2")[0]) for r in sizes.collect()} == {6}


def test_files_that_are_not_read_have_no_pixels(spark):
    files = frames.encode(frames.made(spark, 4, 5, 3), "png").select("image_id", F.lit("x.png").alias("path"), F.when(F.col("image_id") == 2, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")).alias("content"))
    read = codecs.decode(files)
    assert [r.image_id for r in read.where("error is not null").collect()] == [2]
    pixels = codecs.to_pixels(read)
    assert python_steps(pixels) == 2
    assert sorted((r.image_id, r.n) for r in pixels.groupBy("image_id").agg(F.count("*").alias("n")).collect()) == [(0, 15), (1, 15), (3, 15)]


def test_a_batch_of_files_is_not_held_decoded():
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 65536, (300, 300, 3)).astype(np.int32) for _ in range(6)]
    contents = [codecs.codec("tensor")[1](p) for p in images]
    contents.insert(3, b"no file")
    files = pa.RecordBatch.from_pydict({"image_id": list(range(7)), "path": ["x.tensor"] * 7, "format": ["tensor"] * 7, "content": contents})
    decoded = list(codecs.decoded(iter([files])))
    # two images pass the bound, so no batch has three
    assert [len(b) for b in decoded] == [2, 3, 2]
    rows = [r for b in decoded for r in b.to_pylist()]
    assert [r["image_id"] for r in rows] == list(range(7))
    assert [r["error"] is None for r in rows] == [k != 3 for k in range(7)]
    for p, r in zip(images, [r for r in rows if r["error"] is None], strict=True):
        assert (np.frombuffer(r["data"], "<u2").reshape(r["height"], r["width"], r["channels"]) == p).all()
