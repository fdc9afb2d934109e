"""PLY tables, PNG and PNM images, scene JSON, parameter JSON, CSV points and version folders."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions.harmonics import from_rgb
from pointloom.functions.maths import d, focal_to_fov, fov_to_focal
from pointloom.functions.text import base_name, stem
from pointloom.session import qualified, workers_import, written

PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "ushort": "u2", "int": "i4", "int32": "i4", "uint": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def ply_header(data: bytes) -> tuple[np.dtype, int, int]:
    """Row type, number of rows, and where they start, for the vertices of a little-endian PLY."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:end].decode("ascii").splitlines()
    if lines[0] != "ply" or "format binary_little_endian 1.0" not in lines:
        raise ValueError("not a binary little-endian PLY")
    n, fields, inside = 0, [], False
    for line in lines:
        part = line.split()
        if part[:1] == ["element"]:
            inside = part[1] == "vertex"
            n = int(part[2]) if inside else n
        elif part[:1] == ["property"] and inside:
            fields.append((part[2], "<" + PLY_TYPES[part[1]]))
    return np.dtype(fields), n, end


def read_ply(spark: SparkSession, path: str, columns: list[str], rows_per_task: int = 1 << 20) -> DataFrame:
    """The named vertex properties as doubles, with the row's place in its file; only these are decoded.

    Vertices have a fixed width, so a file is read in ranges of rows, by as many tasks as it has ranges and whatever its
    size. The driver reads the headers only.
    """
    workers_import(spark)
    ranges = []
    for file in spark.read.format("binaryFile").load(path).select("path").collect():  # names of files, one for each model
        store, place = fs.FileSystem.from_uri(qualified(spark, file["path"]))
        with store.open_input_file(place) as f:
            _, n, _ = ply_header(f.read(1 << 16))
        ranges += [(file["path"], at, min(rows_per_task, n - at)) for at in range(0, n, rows_per_task)]
    schema = "gid long, " + ", ".join(f"`{c}` double" for c in columns)
    if not ranges:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(where["path"])
                with store.open_input_file(place) as f:
                    kind, _, start = ply_header(f.read(1 << 16))
                    f.seek(start + where["first"] * kind.itemsize)
                    for at in range(where["first"], where["first"] + where["n"], 1 << 16):
                        n = min(1 << 16, where["first"] + where["n"] - at)
                        part = np.frombuffer(f.read(n * kind.itemsize), kind, n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(pa.array(part[c].astype(float)) for c in columns)], ["gid", *columns])

    dealt = spark.createDataFrame([(qualified(spark, p), a, n) for p, a, n in ranges], "path string, first long, n long").repartition(len(ranges))
    return dealt.mapInArrow(run, schema)


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Position, colour in 0..1 and normal of a point cloud."""
    rows = read_ply(spark, path, [*"xyz", "red", "green", "blue", "nx", "ny", "nz"])
    return rows.withColumns({c: F.col(c) / 255 for c in ("red", "green", "blue")})


def write_ply(rows: DataFrame, types: dict[str, str], path: str, key: str = "gid") -> None:
    """One PLY file by key."""
    from pointloom.sources.sparse import packed_parts, write_one_file

    kind = np.dtype([(c, "<" + PLY_TYPES[t]) for c, t in types.items()])

    def packed(batch: pa.RecordBatch) -> bytes:
        out = np.empty(batch.num_rows, kind)
        for c in types:
            out[c] = batch.column(c).to_numpy(zero_copy_only=False)
        return out.tobytes()

    parts = packed_parts(rows.select(key, *types), key, packed)
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {rows.count()}", *(f"property {t} {c}" for c, t in types.items()), "end_header", ""]
    write_one_file(parts, "\n".join(head).encode(), path)


def write_point_cloud(rows: DataFrame, path: str) -> None:
    types = {**dict.fromkeys("xyz", "float"), **dict.fromkeys(("nx", "ny", "nz"), "float"), **dict.fromkeys(("red", "green", "blue"), "uchar")}
    write_ply(rows.withColumns({n: F.lit(0.0) for n in ("nx", "ny", "nz")}), types, path)


def write_splats(rows: DataFrame, path: str) -> None:
    """The 62 columns at degree 3, as they are before activation."""
    from pointloom.operators.structure import SPLAT_COLUMNS

    write_ply(rows, dict.fromkeys(SPLAT_COLUMNS, "float"), path)


def splat_columns(spark: SparkSession, path: str) -> list[str]:
    """Vertex properties of a splat file, of any degree, from the header of the first file."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("head")).first()[0]
    return list(ply_header(bytes(head))[0].names)


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """Splats with arrays f_dc, f_rest, scale and rot in the order of their numbers; a file without whole sets is an error."""
    from pointloom.operators.structure import to_arrays

    names = splat_columns(spark, path)
    rest = sum(n.startswith("f_rest_") for n in names)
    if rest % 3 or round((rest / 3 + 1) ** 0.5) ** 2 != rest / 3 + 1:
        raise ValueError(f"{rest} higher harmonics are no whole degree")
    return to_arrays(read_ply(spark, path, names), ["f_dc", "f_rest", "scale", "rot"])


def random_cloud(spark: SparkSession, n: int = 100_000, seed: int = 0, half: float = 1.3) -> DataFrame:
    """Points uniform in a cube, with random colours; the same for a seed whatever the partitioning."""
    def u(k: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 52)) + 0.5) / (1 << 52)

    rows = spark.range(n)
    colour = [u(3 + k) / 255 * 0.28209479177387814 + 0.5 for k in range(3)]
    return rows.select(F.col("id").alias("gid"), *((u(k) * 2 * half - half).alias(c) for k, c in enumerate("xyz")), *(c.alias(n) for c, n in zip(colour, ("red", "green", "blue"), strict=True)), *(F.lit(0.0).alias(c) for c in ("nx", "ny", "nz")))


def splat_dc(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"f_dc_{k}": from_rgb(F.col(c)) for k, c in enumerate(("red", "green", "blue"))})


# ---- images


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of a PNG's lines without their filters, height x width x step.

    A byte depends on those to the left, above and above to the left, so pixels on one rising diagonal are independent:
    they are decoded together, whatever filters their lines have.
    """
    h, w = len(rows), (rows.shape[1] - 1) // step
    raw = rows[:, 1:].reshape(h, w, step).astype(np.int16)
    out = np.zeros((h + 1, w + 1, step), np.int16)  # a line and a column of zeros before the image
    how = rows[:, 0]
    if how.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    for diagonal in range(h + w - 1 if h and w else 0):
        y = np.arange(max(0, diagonal - w + 1), min(h, diagonal + 1))
        x = diagonal - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        p = a + b - c
        pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
        nearest = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        guess = np.choose(how[y][:, None], [np.zeros_like(a), a, b, (a + b) >> 1, nearest])
        out[y + 1, x + 1] = raw[y, x] + guess & 255
    return out[1:, 1:].astype(np.uint8)


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width x channels of a PNG that is not interlaced: 8 or 16 bits, or a palette, whose colours are looked up."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, raw, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            raw.append(body)
        at += 12 + n
    if interlace or depth not in ((1, 2, 4, 8) if colour == 3 else (8, 16)):
        raise ValueError("kind of PNG not supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = max(1, channels * depth // 8)
    line = -(-w * channels * depth // 8)
    out = _unfiltered(np.frombuffer(zlib.decompress(b"".join(raw)), np.uint8).reshape(h, 1 + line), step).reshape(h, line)
    if colour == 3:
        bits = np.unpackbits(out, axis=1).reshape(h, -1, depth)[:, :w]
        return palette[bits @ (1 << np.arange(depth)[::-1])]
    flat = out.view(">u2") if depth == 16 else out
    return flat.reshape(h, w, channels)


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of height x width x 1, 3 or 4, lightly compressed."""
    h, w, c = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c).astype(np.uint8)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def pnm_pixels(data: bytes) -> np.ndarray:
    kind, w, h, top, body = data.split(None, 4)
    if kind not in (b"P5", b"P6") or int(top) > 255:
        raise ValueError("kind of PNM not supported")
    head = data.index(top, len(kind) + len(w) + len(h) + 2) + len(top) + 1
    return np.frombuffer(data, np.uint8, offset=head).reshape(int(h), int(w), 3 if kind == b"P6" else 1)


def _taps(size: int, target: int) -> np.ndarray:
    """Weights (target x size) of a cubic filter (a = -1/2) that widens with the step, so that shrinking averages."""
    step = size / target
    wide = max(step, 1.0)
    away = np.abs(np.arange(size) + 0.5 - (np.arange(target) + 0.5)[:, None] * step) / wide
    near = ((1.5 * away - 2.5) * away) * away + 1
    far = ((-0.5 * away + 2.5) * away - 4) * away + 2
    w = np.where(away < 1, near, np.where(away < 2, far, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels at another size by a cubic filter along both axes, rounded to their type; as they are at their own size."""
    h, w, _ = pixels.shape
    if (w, h) == (width, height):
        return pixels
    out = np.einsum("yh,hwc->ywc", _taps(h, height), pixels.astype(float), optimize=True)
    out = np.einsum("xw,ywc->yxc", _taps(w, width), out, optimize=True)
    return np.clip(np.round(out), 0, np.iinfo(pixels.dtype).max).astype(pixels.dtype)


#: First bytes of image files that need a decoder from outside.
FOREIGN = {b"\xff\xd8\xff": "jpg", b"RIFF": "webp", b"II*\0": "tif", b"MM\0*": "tif"}


def image_pixels(data: bytes, name: str, decoders: dict | None = None) -> np.ndarray:
    """Pixels of PNG and PNM; other formats by decoders {extension: function of bytes}, refused by name without one."""
    kind = next((k for start, k in FOREIGN.items() if data.startswith(start)), None)
    if kind:
        if not decoders or kind not in decoders:
            raise ValueError(f"{name} is a {kind} image, and no decoder for {kind} was given")
        return decoders[kind](data)
    return (png_pixels if data[:4] == b"\x89PNG" else pnm_pixels)(data)


def read_pixels(spark: SparkSession, path: str, divisor: float = 255.0, size=None, decoders: dict | None = None) -> DataFrame:
    """Pixel relation of images: path, c, y, x, v. Divisors of depth maps: 512 for synthetic scenes, 65536 for real ones.

    size: a function of (width, height) that gives the size to bring images to. decoders: see ``image_pixels``; there is no
    JPEG decoder here.
    """
    workers_import(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                v = image_pixels(content.as_py(), name, decoders)
                if size:
                    v = resized(v, *size(v.shape[1], v.shape[0]))
                y, x, c = (i.ravel().astype(np.int32) for i in np.indices(v.shape))
                yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), pa.array(c), pa.array(y), pa.array(x), pa.array(v.ravel() / divisor)], ["path", "c", "y", "x", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, c int, y int, x int, v double")


def encode_png(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by and png: each image of a pixel relation as 8-bit PNG, one group an image."""
    workers_import(pixels.sparkSession)
    import pandas as pd

    def one(key: tuple, rows):
        shape = rows["y"].max() + 1, rows["x"].max() + 1, rows["c"].max() + 1
        out = np.zeros(shape, np.uint8)
        out[rows["y"], rows["x"], rows["c"]] = np.clip(rows["v"] * 255 + 0.5, 0, 255).astype(np.uint8)
        return pd.DataFrame([[*key, png_bytes(out)]], columns=[*by, "png"])

    kinds = dict(pixels.dtypes)
    return pixels.groupBy(*by).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in by) + ", png binary")


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Write png of each row below folder under its path (such as test/ours_7000/renders/00000.png); returns path and bytes.

    A file appears whole under its name, also when a task is run again.
    """
    workers_import(images.sparkSession)
    target = qualified(images.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            names, sizes = batch.column("path").to_pylist(), []
            for name, png in zip(names, batch.column("png"), strict=True):
                place = f"{base}/{name}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                temporary = f"{place}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(temporary, compression=None) as f:
                    sizes.append(f.write(png.as_buffer()))
                store.move(temporary, place)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return written(images.select("path", "png").mapInArrow(run, "path string, bytes long"), "images")


# ---- JSON and CSV


def read_transforms(spark: SparkSession, path: str, extension: str = ".png") -> DataFrame:
    """Frames of a synthetic scene: idx, camera_angle_x, file_path, image_name, and the camera-to-world matrix with axes 1, 2 flipped."""
    rows = spark.read.schema("camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>").json(path, multiLine=True)
    rows = rows.select("camera_angle_x", F.posexplode("frames").alias("idx", "f"))
    flipped = F.transform("f.transform_matrix", lambda row: F.transform(row, lambda v, j: F.when(j.isin(1, 2), -v).otherwise(v)))
    return rows.select("idx", "camera_angle_x", F.concat("f.file_path", F.lit(extension)).alias("file_path"), F.substring_index("f.file_path", "/", -1).alias("image_name"), flipped.alias("c2w"))


def transform_cameras(frames: DataFrame, sizes: DataFrame, is_test: bool = False) -> DataFrame:
    """Cameras of a synthetic scene. frames: read_transforms; sizes: image_name, width, height.

    R (array of nine, by rows) is the transpose of the world-to-camera rotation and T its translation; fov_y follows from
    fov_x and the size of the image. Matrices are inverted by cofactors, so scaled or sheared axes are right, too.
    """
    rows = frames.join(sizes.select("image_name", "width", "height"), "image_name")
    rows = rows.withColumns({f"_m{i}{j}": F.get(F.get("c2w", F.lit(i)), F.lit(j)) for i in range(3) for j in range(4)})
    m = [[F.col(f"_m{i}{j}") for j in range(4)] for i in range(3)]
    rows = rows.withColumns({f"_c{i}{j}": m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for i in range(3) for j in range(3)})
    rows = rows.withColumn("_det", m[0][0] * F.col("_c00") + m[0][1] * F.col("_c01") + m[0][2] * F.col("_c02"))
    # a cell of the inverse is the cofactor of the transposed cell, so R, its transpose, has the cofactors as they lie
    cell = lambda i, j: F.col(f"_c{j}{i}") / F.col("_det")
    moved = [-(cell(i, 0) * m[0][3] + cell(i, 1) * m[1][3] + cell(i, 2) * m[2][3]) for i in range(3)]
    fov_y = focal_to_fov(fov_to_focal(F.col("camera_angle_x"), d(F.col("width"))), d(F.col("height")))
    return rows.select(
        F.col("idx").alias("uid"), "image_name", "file_path", F.array(*(cell(j, i) for i in range(3) for j in range(3))).alias("R"), F.array(*moved).alias("T"),
        F.col("camera_angle_x").alias("fov_x"), fov_y.alias("fov_y"), "width", "height", F.lit(is_test).alias("is_test"),
    )


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """image_name, width and height of PNG files, from their first bytes."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    rows = spark.read.format("binaryFile").load(path).filter(F.hex(F.substring("content", 1, 4)) == "89504E47")
    return rows.select(stem(base_name(F.col("path"))).alias("image_name"), number(17).alias("width"), number(21).alias("height"))


def read_keyed_json(spark: SparkSession, path: str, value: str, key: str = "name") -> DataFrame:
    """{key: value} of one JSON object as rows; a missing file is an error."""
    return keyed_values(spark.read.text(path, wholetext=True), "value", value, key).select(key, "value")


def keyed_values(rows: DataFrame, column: str, value: str, key: str = "name") -> DataFrame:
    """rows with key and value for each entry of their JSON object {key: value}, instead of the text."""
    return rows.select(*(c for c in rows.columns if c != column), F.explode(F.from_json(column, f"map<string,{value}>")).alias(key, "value"))


def read_depth_params(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_json(spark, path, "struct<scale:double,offset:double>", "stem").select("stem", "value.*")


def read_exposures(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed_json(spark, path, "array<array<double>>", "image_name").withColumnRenamed("value", "m")


def keyed_json(rows: DataFrame, key: str, value) -> DataFrame:
    """One row: {key: value} as a JSON string. For a file of parameters, one entry a view."""
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value.alias("value")))))).alias("json"))


def camera_json(cameras: DataFrame) -> DataFrame:
    """JSON lines, test views first, ids renumbered. cameras: is_test, name, width, height, position, rotation, fx, fy."""
    order = Window.orderBy(F.col("is_test").desc(), "name")  # a file of one scene's views
    ids = cameras.withColumn("id", F.row_number().over(order) - 1)
    return ids.select("id", F.to_json(F.struct("id", F.col("name").alias("img_name"), "width", "height", "position", "rotation", "fy", "fx")).alias("json"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")


def read_semidense(spark: SparkSession, path: str) -> DataFrame:
    """Points of a device capture; grey, without error."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    rows = rows.select(F.col("uid").cast("long").alias("point3d_id"), *(F.col(f"p{c}_world").cast("double").alias(c) for c in "xyz"))
    return rows.withColumns({c: F.lit(128).cast("smallint") for c in "rgb"}).withColumn("error", F.lit(0.0)).withColumn("track", F.array().cast("array<struct<image_id:int,point2d_idx:int>>"))


def write_version(df: DataFrame, folder: str, iteration: int) -> None:
    """A version of a table as its own partition folder."""
    df.write.mode("overwrite").parquet(f"{folder}/iteration={iteration}")


def write_checkpoint(df: DataFrame, folder: str, iteration: int, settings: dict) -> None:
    """A version with its optimizer state as columns, and the settings beside it as one JSON document."""
    write_version(df, f"{folder}/rows", iteration)
    one = df.sparkSession.createDataFrame([(iteration, json.dumps(settings, sort_keys=True))], "iteration long, value string")
    one.coalesce(1).select("value").write.mode("overwrite").text(f"{folder}/settings/iteration={iteration}")


def read_checkpoint(spark: SparkSession, folder: str, iteration: int | None = None) -> tuple[DataFrame, dict]:
    """Rows (with their iteration) and settings of the version named, else the largest."""
    saved = latest(spark, f"{folder}/settings", iteration, "text").first()
    return latest(spark, f"{folder}/rows", saved["iteration"]), json.loads(saved["value"])


def append_scalars(rows: DataFrame, folder: str) -> None:
    """Add rows (run, iteration, tag, value) to a table of scalars."""
    rows.select(F.col("run").cast("string"), F.col("iteration").cast("long"), F.col("tag").cast("string"), F.col("value").cast("double")).write.mode("append").parquet(folder)


def append_images(images: DataFrame, folder: str) -> None:
    """Add rows (run, iteration, tag, png) to a table of rendered views."""
    images.select(F.col("run").cast("string"), F.col("iteration").cast("long"), F.col("tag").cast("string"), "png").write.mode("append").parquet(folder)


def append_histogram(counts: DataFrame, folder: str, run: str, iteration: int, tag: str, bins: int) -> None:
    """Add a histogram of 0..1 (bin, n) to a table of histograms: run, iteration, tag, low, high, n."""
    edge = lambda k: (k / bins).cast("double")
    rows = counts.select(F.lit(run).alias("run"), F.lit(iteration).cast("long").alias("iteration"), F.lit(tag).alias("tag"), edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.col("n").cast("long").alias("n"))
    rows.write.mode("append").parquet(folder)


def write_timing(elapsed: DataFrame, by: str, path: str) -> None:
    """One text file of the minutes of each suite (column elapsed, in seconds); suites are few."""
    line = F.format_string("%s: %s minutes", F.col(by), (F.col("elapsed") / 60).cast("string"))
    elapsed.orderBy(by).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_settings(spark: SparkSession, settings: dict, folder: str) -> None:
    """The settings of a run as one JSON document beside its model."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def read_settings(spark: SparkSession, folder: str) -> dict:
    """Saved settings; none where a folder has none, so that a command line alone decides."""
    from pointloom.sources.sparse import _exists

    return json.loads(spark.read.text(folder, wholetext=True).first()[0]) if _exists(spark, folder) else {}


def latest(spark: SparkSession, folder: str, iteration: int | None = None, kind: str = "parquet") -> DataFrame:
    """A version of a table: the one named (0 too), else the largest."""
    rows = spark.read.format(kind).load(folder)
    if iteration is None:
        iteration = rows.agg(F.max("iteration")).first()[0]
    return rows.filter(F.col("iteration") == iteration)


def scene_kind(spark: SparkSession, folder: str) -> str:
    """sparse or transforms, by what the folder holds."""
    from pointloom.sources.sparse import _exists

    if _exists(spark, f"{folder}/sparse"):
        return "sparse"
    if _exists(spark, f"{folder}/transforms_train.json"):
        return "transforms"
    raise FileNotFoundError(f"no scene in {folder}")
