"""Times the published set of image operators on rasters of about 100 Mpx and the catalogue's headline queries at $BENCH_SF_DIR.

Runs on local[$BENCH_CPUS] and prints one line of JSON: seconds of each, and millions of pixels a second of those on rasters.
The rasters are made by formula and written once before the clock starts; each figure reads them and drops its result.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")  # a task is one core

QUERIES = ["flagship", "grayscale", "roundtrip_lab", "blend_over", "compare_measures", "statistics", "otsu", "sharpen", "statistic_median", "average_hash", "components", "codec_qoi", "fx_functions", "steps_halo"]


def main() -> None:
    import numpy as np
    from pyspark.sql import SparkSession

    from pixelweave import catalog
    from pixelweave.operators import frames
    from pixelweave.sources import codecs

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    folder = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoints")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()

    def table(name: str, df):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    tasks = 4 * int(cpus)
    small, medium, large = (table(f"images{side}", frames.made(spark, count, side, side, tasks)) for count, side in ((1600, 256), (400, 512), (96, 1024)))
    # a few images of every file, so that all cores have some
    few, some = small.where("image_id % 25 = 0"), medium.where("image_id % 12 = 0 and image_id < 384")
    # both images of a pair lie in the bucket of their id: comparing them shuffles neither
    for name, df in (("first", small), ("soft", frames.gaussian_blur(small, 1.0))):
        df.repartition(tasks, "image_id").write.bucketBy(tasks, "image_id").sortBy("image_id").option("path", f"{folder}/bucketed/{name}").saveAsTable(name)
    first, soft = spark.table("first"), spark.table("soft")
    overlay = np.dstack([np.full((256, 256, 3), 40_000), np.linspace(0, 65_535, 256 * 256).reshape(256, 256, 1)])
    files = lambda df, kind: frames.encode(df, kind).selectExpr("image_id", f"'x.{kind}' AS path", "content")
    png, jpeg = table("png", files(some, "png")), table("jpeg", files(some, "jpeg"))
    raw = table("raw", frames.mosaic(large))
    # query, and millions of pixels: of the result where the published figures count those, else of the input
    rasters = {
        "resize_nearest_256_128": (lambda: frames.sample(small, 128, 128), 1600 * 128 * 128),
        "resize_lanczos3_256_128": (lambda: frames.resize(small, 128, 128), 1600 * 128 * 128),
        "resize_lanczos3_1024_512": (lambda: frames.resize(large, 512, 512), 96 * 512 * 512),
        "resize_lanczos3_1024_2048": (lambda: frames.resize(large, 2048, 2048), 96 * 2048 * 2048),
        "gaussian_blur_256": (lambda: frames.gaussian_blur(small, 1.0), 1600 * 256 * 256),
        "gaussian_blur_512": (lambda: frames.gaussian_blur(medium, 1.0), 400 * 512 * 512),
        "sharpen_256": (lambda: frames.sharpen(small, 1.0), 1600 * 256 * 256),
        "motion_blur_512": (lambda: frames.motion_blur(medium, 5, 2.0, 45.0), 400 * 512 * 512),
        "equalize_256": (lambda: frames.equalize(small), 1600 * 256 * 256),
        "normalize_256": (lambda: frames.normalize(small), 1600 * 256 * 256),
        "png_encode_512": (lambda: frames.encode(some, "png"), 32 * 512 * 512),
        "png_decode_512": (lambda: codecs.decode(png), 32 * 512 * 512),
        "jpeg_encode_512": (lambda: frames.encode(some, "jpeg"), 32 * 512 * 512),
        "jpeg_decode_512": (lambda: codecs.decode(jpeg), 32 * 512 * 512),
        "mse_256": (lambda: frames.mse(first, soft), 1600 * 256 * 256),
        "ssim_256": (lambda: frames.ssim(first, soft), 1600 * 256 * 256),
        "composite_over_512": (lambda: frames.composite_over(medium, overlay, 128, 128), 400 * 512 * 512),
        "canny_256": (lambda: frames.canny(small.where("image_id < 400")), 400 * 256 * 256),
        "seam_carve_256_200": (lambda: frames.seam_carve(few, 200, 256), 64 * 256 * 256),
        "demosaic_1024": (lambda: frames.demosaic(raw), 96 * 1024 * 1024),
    }
    queries = catalog.queries()
    sink(frames.sample(few, 8, 8))
    sink(queries["flagship"](spark, sf_dir))
    start = time.time()
    sink(spark.range(1))
    overhead = time.time() - start
    seconds, speed = {}, {}
    for name, (query, pixels) in rasters.items():
        start = time.time()
        sink(query())
        seconds[name] = round(time.time() - start, 3)
        speed[name] = round(pixels / 1e6 / seconds[name], 2)
    for name in QUERIES:
        start = time.time()
        sink(queries[name](spark, sf_dir))
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "mpx_per_sec": speed, "job_overhead": round(overhead, 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
