"""Blocks of images and dense maps against whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import metrics, rasters
from pointloom.sources import files


def dense_file(v):
    """v: height x width x channels."""
    h, w, c = v.shape
    return f"{w}&{h}&{c}&".encode() + v.astype("<f4").transpose(1, 0, 2).tobytes(order="F")


def interpolated(v, x, y):
    h, w = v.shape
    x0, y0 = int(np.floor(x)), int(np.floor(y))
    at = lambda i, j: v[min(max(j, 0), h - 1), min(max(i, 0), w - 1)]
    fx, fy = x - x0, y - y0
    return (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy


@pytest.mark.parametrize(("height", "width"), [(9, 13), (8, 8), (1, 1), (4, 17), (5, 4)])
def test_dense_maps_in_blocks(spark, tmp_path, height, width):
    rng = np.random.default_rng(height)
    v = rng.random((height, width, 2)).astype("<f4")
    (tmp_path / "d.bin").write_bytes(dense_file(v))
    blocks = rasters.read_dense_blocks(spark, str(tmp_path / "d.bin"), 4)
    assert blocks.count() == 2 * -(-height // 4) * -(-width // 4)
    got = {(r.c, r.y, r.x): r.v for r in rasters.to_pixels(blocks, ["c"], 4).collect()}
    assert got == {(c, y, x): float(v[y, x, c]) for c in range(2) for y in range(height) for x in range(width)}
    points = [(c, float(x), float(y)) for c in range(2) for x, y in rng.uniform(-3, 20, (60, 2)).tolist() + [[3.0, 3.0], [4.0, 3.5], [3.999, 4.0], [-0.0, 0.0], [7.5, 7.5]]]
    samples = spark.createDataFrame(points, "c int, sx double, sy double")
    out = rasters.bilinear(samples, blocks, ["c"], 4).collect()
    assert len(out) == len(points)
    for r in out:
        assert abs(r.v - interpolated(v[:, :, r.c].astype(float), r.sx, r.sy)) < 1e-6


def test_blocks_of_pixels_and_depth_images(spark, tmp_path):
    v = np.random.default_rng(3).integers(0, 65536, (11, 6, 1)).astype(np.uint16)
    (tmp_path / "d.png").write_bytes(files.png_bytes(v) if v.dtype == np.uint8 else png16(v))
    blocks = rasters.read_image_blocks(spark, str(tmp_path / "d.png"), block=4)
    got = {(r.y, r.x): r.v for r in rasters.to_pixels(blocks, ["c"], 4).collect()}
    assert got == {(y, x): v[y, x, 0] / 65536 for y in range(11) for x in range(6)}
    pixels = spark.createDataFrame([("a", y, x, float(y * 6 + x)) for y in range(11) for x in range(6)] + [(None, 2, 1, 5.0)], "name string, y int, x int, v double")
    made = rasters.from_pixels(pixels, ["name"], 4)
    assert made.filter("name is null").count() == 1 and made.filter("name = 'a'").select("height", "width").distinct().collect() == [(11, 6)]
    samples = spark.createDataFrame([("a", 2.5, 7.25, 1), ("none", 0.0, 0.0, 2)], "name string, sx double, sy double, id int")
    assert [tuple(r) for r in rasters.bilinear(samples, made, ["name"], 4).collect()] == [("a", 2.5, 7.25, 1, 46.0)]
    holes = rasters.to_pixels(made.filter("name is null"), [], 4)
    assert holes.filter("v is not null").collect() == [(1, 2, 5.0)] and holes.count() == 6


def png16(v):
    import struct
    import zlib

    h, w, _ = v.shape
    raw = b"".join(b"\0" + v[y, :, 0].astype(">u2").tobytes() for y in range(h))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_samples_shuffle_blocks_not_pixels(spark):
    """The join has a row a block on one side and the samples on the other."""
    blocks = spark.range(6).select(F.lit("m").alias("name"), F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), F.lit(64).alias("height"), F.lit(384).alias("width"), F.array_repeat(F.lit(1.5), 65 * 65).alias("data"))
    samples = spark.range(100).select(F.lit("m").alias("name"), (F.col("id") * 3.7).alias("sx"), F.lit(5.5).alias("sy"))
    out = rasters.bilinear(samples, blocks, ["name"], 64)
    assert out.count() == 100 and {r.v for r in out.collect()} == {1.5}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def brute_ssim(a, b):
    w = np.array([np.exp(-((k - 5) ** 2) / (2 * 1.5**2)) for k in range(11)])
    w = np.outer(w, w) / w.sum() ** 2
    blur = lambda p: np.array([[(np.pad(p, 5)[y : y + 11, x : x + 11] * w).sum() for x in range(p.shape[1])] for y in range(p.shape[0])])
    ma, mb = blur(a), blur(b)
    aa, bb, ab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return (2 * ma * mb + 1e-4) * (2 * ab + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (aa + bb + 9e-4))


@pytest.mark.parametrize("tile", [256, 16, 7, 3])
def test_ssim_by_tiles(spark, tile):
    """Tiles of any size, also smaller than the stencil, give the values of whole planes, at borders and corners too."""
    rng = np.random.default_rng(1)
    images = {"p": rng.random((20, 33)), "q": rng.random((5, 7)), None: rng.random((12, 4))}
    rows, want = [], {}
    for name, a in images.items():
        b = np.clip(a + rng.normal(0, 0.1, a.shape), 0, 1)
        a, b = a.copy(), b.copy()
        if name == "p":  # most of the image is missing, the far corner is there
            a[3:19, 2:30] = b[3:19, 2:30] = 0
        rows += [(name, 0, y, x, float(a[y, x]), float(b[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if a[y, x] or b[y, x]]
        want[name] = brute_ssim(a, b).mean()
    both = spark.createDataFrame(rows, "name string, c int, y int, x int, a double, b double").repartition(4)
    got = {r.name: r.ssim for r in metrics.ssim(both, ["name"], tile=tile).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ssim_of_a_large_image(spark):
    """A third of a million pixels in tiles: no group has more than one tile and its borders."""
    n = 600
    both = spark.range(n * n).select(F.lit("big").alias("name"), F.lit(0).alias("c"), F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    both = both.withColumn("a", F.abs(F.sin(F.col("x") * 0.1 + F.col("y")))).withColumn("b", F.abs(F.cos(F.col("x") * 0.2)))
    assert rasters.dealt(both, 128, 5, 5).groupBy("row", "col").count().agg(F.max("count")).first()[0] == 138 * 138
    one = metrics.ssim(both, ["name"], tile=128).first().ssim
    assert abs(one - metrics.ssim(both, ["name"], tile=1024).first().ssim) < 1e-9
