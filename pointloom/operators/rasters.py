"""Images and dense maps as blocks: arrays of pixels with those of their neighbours that an operation needs.

A block is a square of ``block`` pixels a side; ``low`` and ``high`` more pixels before and after it belong to other blocks,
too. What runs on blocks shuffles a row a block, however many pixels there are, and a task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.functions.maths import d
from pointloom.session import arrow_uri, workers_import
from pointloom.sources.files import image_pixels

BLOCK = 256
RASTER = "row long, col long, height int, width int, data array<double>"
NAMES = ["row", "col", "height", "width", "data"]


def dealt(pixels: DataFrame, block: int = BLOCK, low: int = 0, high: int = 0) -> DataFrame:
    """pixels (x, y) with row and col: a row for each block that has a pixel in it or within its low or high border."""
    span = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - high) / block), F.lit(0)), F.floor((F.col(c) + low) / block)))
    return pixels.withColumn("row", span("y")).withColumn("col", span("x"))


def plane(rows: pa.Table, column: str, row: int, col: int, block: int, low: int, high: int, empty: float, size: tuple[int, int] | None = None) -> np.ndarray:
    """The pixels of a block (of size, if it is smaller) and its borders as an array; what no row gives is ``empty``."""
    h, w = size or (block, block)
    out = np.full((h + low + high, w + low + high), empty)
    out[rows["y"].to_numpy() - row * block + low, rows["x"].to_numpy() - col * block + low] = rows[column].to_numpy()
    return out


def from_pixels(pixels: DataFrame, by: list[str], block: int = BLOCK, value: str = "v") -> DataFrame:
    """by and blocks (RASTER) with a pixel of overlap after them, from a pixel relation (by, x, y, v); missing pixels are NULL.

    Maps have the size that their pixels reach.
    """
    workers_import(pixels.sparkSession)
    rows = pixels.select(F.struct(*by).alias("_key"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    size = rows.groupBy("_key").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    schema = T.StructType([rows.schema["_key"], *T.StructType.fromDDL("row long, col long, data array<double>").fields])
    arrow = to_arrow_schema(schema)

    def one(key: tuple, found: pa.Table) -> pa.Table:
        out = plane(found, "v", key[1].as_py(), key[2].as_py(), block, 0, 1, np.nan)
        data = [None if v != v else v for v in out.ravel().tolist()]
        return pa.Table.from_pylist([{"_key": key[0].as_py(), "row": key[1].as_py(), "col": key[2].as_py(), "data": data}], arrow)

    made = dealt(rows, block, 0, 1).groupBy("_key", "row", "col").applyInArrow(one, schema)
    return made.join(size, "_key").select("_key.*", *NAMES)


def _cut(v: np.ndarray, first: int, height: int, block: int) -> Iterator[tuple]:
    """row, col, height, width, data of the blocks of a band of whole lines from first on."""
    width, side = v.shape[1], block + 1
    for top in range(0, min(len(v), height - first), block):
        if top and len(v) - top == 1 and first + top + 1 < height:
            return  # the overlap with the next band
        for col in range(-(-width // block)):
            part = v[top : top + side, col * block : col * block + side]
            data = np.full((side, side), np.nan)
            data[: part.shape[0], : part.shape[1]] = part
            yield (first + top) // block, col, height, width, data.ravel()


def _batch(head: dict, cut: tuple, schema: pa.Schema) -> pa.RecordBatch:
    *numbers, data = cut
    arrays = [pa.array([v]) for v in (*head.values(), *numbers)]
    values = pa.array(data, mask=np.isnan(data))
    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), values))
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def dense_header(start: bytes) -> tuple[int, int, int, int]:
    """width, height, channels of a dense map, and where its numbers begin."""
    parts = start.split(b"&", 3)
    w, h, c = (int(v) for v in parts[:3])
    return w, h, c, len(start) - len(parts[3])


def read_dense_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """path, c and blocks of dense maps (ASCII width&height&channels& and float32, x fastest, then y, then channel).

    Lines are whole in the file, so bands of block lines are read by seeking, each in a task of its own if need be.
    """
    workers_import(spark)
    names = spark.read.format("binaryFile").load(path).select("path")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(arrow_uri(name))
                with store.open_input_file(place) as f:
                    w, h, c, start = dense_header(f.read(256))
                    if f.size() < start + 4 * w * h * c:
                        raise ValueError(f"{name}: {w} x {h} x {c} numbers do not fit its {f.size()} bytes")
                bands = [(name, k, top, h, w, start) for k in range(c) for top in range(0, h, block)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*bands, strict=True)], ["path", "c", "top", "height", "width", "start"])

    schema = T.StructType.fromDDL(f"path string, c int, {RASTER}")
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(arrow_uri(b["path"]))
                n = min(block + 1, b["height"] - b["top"])
                with store.open_input_file(place) as f:
                    f.seek(b["start"] + 4 * b["width"] * (b["top"] + b["height"] * b["c"]))
                    v = np.frombuffer(f.read(4 * b["width"] * n), "<f4").reshape(n, b["width"]).astype(float)
                for cut in _cut(v[: block + 1], b["top"], b["height"], block):
                    if cut[0] * block == b["top"]:
                        yield _batch({"path": b["path"], "c": b["c"]}, cut, arrow)

    bands = names.mapInArrow(heads, "path string, c long, top long, height long, width long, start long")
    return bands.repartition("path", "c", "top").mapInArrow(read, schema)


def read_image_blocks(spark: SparkSession, path: str, divisor: float = 65536.0, decoders: dict | None = None, block: int = BLOCK) -> DataFrame:
    """path, c and blocks of images, such as 16-bit depth maps; a compressed image is decoded whole."""
    workers_import(spark)
    schema = T.StructType.fromDDL(f"path string, c int, {RASTER}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                v = image_pixels(content.as_py(), name, decoders)
                for c in range(v.shape[2]):
                    for cut in _cut(v[:, :, c] / divisor, 0, v.shape[0], block):
                        yield _batch({"path": name, "c": c}, cut, arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def to_pixels(blocks: DataFrame, keep: list[str], block: int = BLOCK) -> DataFrame:
    """keep, x, y and v: the pixels of blocks, each once."""
    side = block + 1
    flat = blocks.select(*keep, *NAMES[:-1], F.posexplode("data").alias("_k", "v"))
    flat = flat.withColumns({"_y": F.floor(F.col("_k") / side), "_x": F.col("_k") % side}).filter((F.col("_y") < block) & (F.col("_x") < block))
    flat = flat.withColumns({"x": (F.col("col") * block + F.col("_x")).cast("int"), "y": (F.col("row") * block + F.col("_y")).cast("int")})
    return flat.filter((F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))).select(*keep, "x", "y", "v")


def bilinear(samples: DataFrame, blocks: DataFrame, by: list[str], block: int = BLOCK, out: str = "v") -> DataFrame:
    """samples (by, sx, sy) with the interpolated value of blocks (by, RASTER); borders are repeated.

    A sample meets the one block that has its four pixels: one equi-join by block, whose size does not depend on the pixels.
    Samples of maps without blocks are left out; a missing pixel gives NULL.
    """
    size = blocks.filter("row = 0 and col = 0").select(*by, F.col("height").alias("_h"), F.col("width").alias("_w"))
    rows = samples.join(size, by)

    def inside(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0).cast("long")), top - 1)

    corners = {f"_{c}{k}": inside(F.floor(s) + k, F.col(top)) for c, s, top in (("x", "sx", "_w"), ("y", "sy", "_h")) for k in (0, 1)}
    rows = rows.withColumns(corners)
    rows = rows.withColumns({"_row": F.floor(F.col("_y0") / block), "_col": F.floor(F.col("_x0") / block)})
    mine = blocks.select(*by, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("data").alias("_data"))
    rows = rows.join(mine, [*by, "_row", "_col"])
    at = lambda i, j: F.get("_data", ((F.col(f"_y{j}") - F.col("_row") * block) * (block + 1) + F.col(f"_x{i}") - F.col("_col") * block).cast("int"))
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    value = (at(0, 0) * (1 - fx) + at(1, 0) * fx) * (1 - fy) + (at(0, 1) * (1 - fx) + at(1, 1) * fx) * fy
    return rows.select(*samples.columns, d(value).alias(out))
