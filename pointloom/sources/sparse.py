"""Sparse photogrammetry models: cameras, images and points in binary and text files, read and written.

Binary images and points are read in pieces (``model_format``), camera files, which are small, file by file. Text files are
read line by line by Spark; the two lines of an image are paired across the splits of a file. All readers give explicit
schemas.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions.maths import scalar_first
from pointloom.session import qualified, workers_import, written

#: Camera models of the format by id, with their number of parameters.
CAMERA_MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}
MODEL_IDS = {name: k for k, (name, _) in CAMERA_MODELS.items()}



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_I, _L, _D, _S, _H = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.ShortType()
CAMERA = _struct(camera_id=_I, model=_S, width=_L, height=_L, params=T.ArrayType(_D))
IMAGE = _struct(image_id=_I, qvec=T.ArrayType(_D), tvec=T.ArrayType(_D), camera_id=_I, name=_S, points2d=T.ArrayType(_struct(x=_D, y=_D, point3d_id=_L)))
POINT = _struct(point3d_id=_L, x=_D, y=_D, z=_D, r=_H, g=_H, b=_H, error=_D, track=T.ArrayType(_struct(image_id=_I, point2d_idx=_I)))
OBSERVED = np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")])
TRACKED = np.dtype([("image_id", "<i4"), ("point2d_idx", "<i4")])


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out


def parse_cameras(data: bytes) -> Iterator[dict]:
    c, seen = Cursor(data), set()
    for _ in range(c.take("Q")[0]):
        ident, model, width, height = c.take("iiQQ")
        name, n = CAMERA_MODELS[model]
        if ident in seen:
            raise ValueError(f"camera {ident} twice")
        seen.add(ident)
        yield {"camera_id": ident, "model": name, "width": width, "height": height, "params": list(c.take("d" * n))}


def _whole_files(spark: SparkSession, path: str, schema: T.StructType, parse) -> DataFrame:
    workers_import(spark)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for row in parse(data.as_py()):
                    rows.append(row)
                    if len(rows) == 2048:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_cameras_binary(spark: SparkSession, path: str) -> DataFrame:
    return _whole_files(spark, path, CAMERA, parse_cameras)


def read_images_binary(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    from pointloom.sources.model_format import read_pieces

    return read_pieces(spark, path, "images", columns)


def read_points_binary(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    from pointloom.sources.model_format import read_pieces

    return read_pieces(spark, path, "points", columns)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")
    return rows.select(F.split("line", r"\s+").alias("f"))


def _numbers(f: Column, start: int) -> Column:
    return F.slice(f, F.lit(start + 1), F.greatest(F.size(f) - start, F.lit(0))).cast("array<double>")


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _lines(spark, path).select(f[0].cast("int").alias("camera_id"), f[1].alias("model"), f[2].cast("long").alias("width"), f[3].cast("long").alias("height"), _numbers(f, 4).alias("params"))


def paired_lines(spark: SparkSession, path: str) -> DataFrame:
    """first, second: the two lines of each record of text files, trimmed, wherever the files are split.

    A comment or a blank line where a first line is looked for is left out; where a second one is, it is that second line.
    So what a line is depends on those before it, but each leaves one of two states (a first or a second line is next), and
    a comment or blank line always the former. A split gives its final state for either initial state, and its outermost
    lines; the initial states of a file's splits follow from these rows, one a split, and records that lie across a split's
    end are put together from them.
    """
    from pyspark.sql import Window

    workers_import(spark)
    at = ["file", "split"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array, np.ndarray]]:
        """The rows of one split: its name, trimmed lines, and which of them are comments or blank."""
        files, splits = batch.column("file"), np.asarray(batch.column("split"))
        value = pc.utf8_trim_whitespace(batch.column("value"))
        idle = np.asarray(pc.or_(pc.equal(value, ""), pc.starts_with(value, "#")).cast(pa.int8())).astype(bool)
        names = np.asarray(files.dictionary_encode().indices)
        cuts = [0, *(np.flatnonzero((splits[1:] != splits[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), len(splits)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield (files[a].as_py(), int(splits[a])), value.slice(a, b - a), idle[a:b]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each split: whether a comment or blank line resets it, lines after the last of those, and its outer lines."""
        found: dict[tuple, list] = {}
        for batch in batches:
            for name, value, idle in parts(batch):
                one = found.setdefault(name, [False, 0, value[0].as_py(), None])
                resets = np.flatnonzero(idle)
                one[1] = len(idle) - 1 - int(resets[-1]) if len(resets) else one[1] + len(idle)
                one[0], one[3] = one[0] or len(resets) > 0, value[-1].as_py()
        columns = zip(*((*k, *v) for k, v in found.items()), strict=True) if found else [[]] * 6
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*at, "reset", "odd", "top", "bottom"])

    splits = written(lines.mapInArrow(ends, "file string, split long, reset boolean, odd long, top string, bottom string"), "splits")
    order = Window.partitionBy("file").orderBy("split")  # a row a split
    runs = splits.withColumn("run", F.count_if("reset").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # lines since the last reset, at each split's end: an odd number leaves a second line to come
    since = F.sum("odd").over(Window.partitionBy("file", "run").orderBy("split"))
    states = runs.withColumn("pending", since % 2 == 1).withColumn("entry", F.coalesce(F.lag("pending").over(order), F.lit(False)))
    states = written(states.withColumn("next", F.coalesce(F.lead("top").over(order), F.lit(""))), "states")
    across = states.filter("pending").select(F.col("bottom").alias("first"), F.col("next").alias("second"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, since, held = None, 0, None
        for batch in batches:
            entries = np.asarray(batch.column("entry").cast(pa.int8()))
            done = 0
            for name, value, idle in parts(batch):
                if name != now:
                    now, since, held = name, int(entries[done]), None
                done += len(idle)
                place = np.arange(len(idle))
                last = np.maximum.accumulate(np.where(idle, place, -1))
                before = np.concatenate([[-1], last[:-1]])  # the last reset before a line
                first = ~idle & (np.where(before < 0, place + since, place - before - 1) % 2 == 0)
                at_first = np.flatnonzero(first)
                inner = at_first[at_first < len(idle) - 1]
                left, right = value.take(pa.array(inner)), value.take(pa.array(inner + 1))
                if held is not None:
                    left, right = pa.concat_arrays([pa.array([held], value.type), left]), pa.concat_arrays([value.slice(0, 1), right])
                held = value[-1].as_py() if first[-1] else None
                since = int(len(idle) - 1 - last[-1]) if last[-1] >= 0 else since + len(idle)
                yield pa.RecordBatch.from_arrays([left, right], ["first", "second"])

    told = lines.join(F.broadcast(states.select(*at, "entry")), at)  # a row a split; rows stay in order
    return told.select(*at, "value", "entry").mapInArrow(pair, "first string, second string").unionByName(across)


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    f, p = F.col("f"), F.col("p")
    rows = paired_lines(spark, path).select(F.split("first", r"\s+").alias("f"), F.split("second", r"\s+").alias("p"))
    count = F.floor(F.size(p) / 3).cast("int")
    seen = lambda i: F.struct(p[3 * i].cast("double").alias("x"), p[3 * i + 1].cast("double").alias("y"), p[3 * i + 2].cast("long").alias("point3d_id"))
    points = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), seen)).otherwise(F.array().cast(IMAGE["points2d"].dataType))
    return rows.select(f[0].cast("int").alias("image_id"), F.slice(f, 2, 4).cast("array<double>").alias("qvec"), F.slice(f, 6, 3).cast("array<double>").alias("tvec"), f[8].cast("int").alias("camera_id"), f[9].alias("name"), points.alias("points2d"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    count = F.floor((F.size(f) - 8) / 2).cast("int")
    pair = lambda i: F.struct(f[8 + 2 * i].cast("int").alias("image_id"), f[9 + 2 * i].cast("int").alias("point2d_idx"))
    track = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), pair)).otherwise(F.array().cast(POINT["track"].dataType))
    return _lines(spark, path).select(
        f[0].cast("long").alias("point3d_id"), *(f[1 + i].cast("double").alias(c) for i, c in enumerate("xyz")),
        *(f[4 + i].cast("smallint").alias(c) for i, c in enumerate("rgb")), f[7].cast("double").alias("error"), track.alias("track"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def model_format(spark: SparkSession, folder: str) -> str:
    """bin if the binary model is whole, else txt; an error when neither is."""
    for ext in ("bin", "txt"):
        if all(_exists(spark, f"{folder}/{n}.{ext}") for n in ("cameras", "images", "points3D")):
            return ext
    raise FileNotFoundError(f"no model in {folder}")


def read_model(spark: SparkSession, folder: str, ext: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    ext = (ext or model_format(spark, folder)).lstrip(".")
    readers = {"bin": (read_cameras_binary, read_images_binary, read_points_binary), "txt": (read_cameras_text, read_images_text, read_points_text)}[ext]
    return tuple(r(spark, f"{folder}/{n}.{ext}") for r, n in zip(readers, ("cameras", "images", "points3D"), strict=True))


# ---- writers


def camera_lines(cameras: DataFrame) -> DataFrame:
    return cameras.select(F.col("camera_id").alias("id"), F.lit(0).alias("part"), F.concat_ws(" ", "camera_id", "model", "width", "height", F.array_join(F.col("params").cast("array<string>"), " ")).alias("value"))


def image_lines(images: DataFrame) -> DataFrame:
    """Two lines a record, in order of id and part."""
    pose = F.concat_ws(" ", "image_id", F.array_join(F.col("qvec").cast("array<string>"), " "), F.array_join(F.col("tvec").cast("array<string>"), " "), "camera_id", "name")
    seen = F.array_join(F.transform("points2d", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["point3d_id"].cast("string"))), " ")
    return images.select(F.col("image_id").alias("id"), F.posexplode(F.array(pose, seen)).alias("part", "value"))


def point_lines(points: DataFrame) -> DataFrame:
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["point2d_idx"].cast("string"))), " ")
    return points.select(F.col("point3d_id").alias("id"), F.lit(0).alias("part"), F.concat_ws(" ", "point3d_id", "x", "y", "z", "r", "g", "b", "error", track).alias("value"))


def write_lines(lines: DataFrame, head: list[str], path: str) -> None:
    """One text file (the format is one) with a head, sorted by id."""
    spark = lines.sparkSession
    top = spark.createDataFrame([(-(1 << 62), k, h) for k, h in enumerate(head)], "id long, part int, value string")
    rows = top.unionByName(lines.select(F.col("id").cast("long").alias("id"), F.col("part").cast("int").alias("part"), "value"))
    rows.coalesce(1).sortWithinPartitions("id", "part").select("value").write.mode("overwrite").text(path)


def write_model_text(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    seen = images.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("points2d")), F.lit(0.0)).alias("mean")).first()
    tracks = points.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("track")), F.lit(0.0)).alias("mean")).first()
    write_lines(camera_lines(cameras), ["# Camera list with one line of data per camera:", "#   CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]", f"# Number of cameras: {cameras.count()}"], f"{folder}/cameras.txt")
    write_lines(image_lines(images), ["# Image list with two lines of data per image:", "#   IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME", "#   POINTS2D[] as (X, Y, POINT3D_ID)", f"# Number of images: {seen['n']}, mean observations per image: {seen['mean']}"], f"{folder}/images.txt")
    write_lines(point_lines(points), ["# 3D point list with one line of data per point:", "#   POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)", f"# Number of points: {tracks['n']}, mean track length: {tracks['mean']}"], f"{folder}/points3D.txt")


def _each(pack):
    """A function of a batch from one of a row: these records have lists of their own length."""
    return lambda batch: b"".join([pack(r) for r in batch.to_pylist()])


def pack_camera(r) -> bytes:
    return struct.pack("<iiQQ", r["camera_id"], MODEL_IDS[r["model"]], r["width"], r["height"]) + np.array(r["params"], "<f8").tobytes()


def _items(lists: pa.Array, kind: np.dtype) -> list[bytes]:
    """Each list of structs as packed records; the columns of all lists are filled at once."""
    flat = lists.flatten()
    out = np.empty(len(flat), kind)
    for c in kind.names:
        out[c] = flat.field(c).to_numpy(zero_copy_only=False)
    raw, sizes = out.tobytes(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes) * kind.itemsize
    return [struct.pack("<Q", n) + raw[e - n * kind.itemsize : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def pack_images(batch: pa.RecordBatch) -> bytes:
    rows = batch.select(["image_id", "qvec", "tvec", "camera_id", "name"]).to_pylist()
    heads = [struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" for r in rows]
    return b"".join([h + s for h, s in zip(heads, _items(batch.column("points2d"), OBSERVED), strict=True)])


POINT_HEAD = np.dtype([("point3d_id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("error", "<f8")])


def pack_points(batch: pa.RecordBatch) -> bytes:
    out = np.empty(batch.num_rows, POINT_HEAD)
    for c in POINT_HEAD.names:
        out[c] = batch.column(c).to_numpy(zero_copy_only=False)
    raw, n = out.tobytes(), POINT_HEAD.itemsize
    return b"".join([raw[k * n : (k + 1) * n] + t for k, t in enumerate(_items(batch.column("track"), TRACKED))])


def packed_parts(rows: DataFrame, key: str, pack) -> DataFrame:
    """Records in binary form, a blob for each batch of rows, with its first key and count: parts of one file in order."""
    workers_import(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(key)[0].as_py()], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([pack(batch)], pa.binary())], ["first", "n", "data"])

    return rows.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, "first long, n long, data binary")


def write_one_file(parts: DataFrame, head: bytes, path: str) -> None:
    """head and all parts in order as one file. The format is a single file, so one task writes it, part after part;
    packing stays parallel, and the task holds one part at a time. It appears whole, also when a task is run again."""
    workers_import(parts.sparkSession)
    target = qualified(parts.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(target)
        temporary = f"{place}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(temporary, compression=None) as f:
            f.write(head)
            for batch in batches:
                for data in batch.column("data"):
                    f.write(data.as_buffer())
        store.move(temporary, place)
        yield pa.RecordBatch.from_arrays([pa.array([place])], ["path"])

    parts.repartition(1).sortWithinPartitions("first").mapInArrow(run, "path string").count()


def write_binary(rows: DataFrame, key: str, pack, path: str) -> None:
    """A count and all records by id in one file."""
    write_one_file(packed_parts(rows, key, pack), struct.pack("<Q", rows.count()), path)


def write_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str, ext: str = "bin") -> None:
    if ext.lstrip(".") == "txt":
        write_model_text(cameras, images, points, folder)
        return
    write_binary(cameras, "camera_id", _each(pack_camera), f"{folder}/cameras.bin")
    write_binary(images, "image_id", pack_images, f"{folder}/images.bin")
    write_binary(points, "point3d_id", pack_points, f"{folder}/points3D.bin")


def export_capture(frames: DataFrame, cameras: DataFrame, points: DataFrame, folder: str, ext: str = "txt") -> None:
    """A model folder of a device capture. frames: what ``views.capture_frames`` gives for poses with q (x, y, z, w) and t.

    Images have no observations, points no tracks; cameras has one row, camera 1.
    """
    images = frames.select(F.col("image_id").cast("int").alias("image_id"), scalar_first(F.col("q")).alias("qvec"), F.col("t").alias("tvec"), F.lit(1).alias("camera_id"), "name", F.array().cast(IMAGE["points2d"].dataType).alias("points2d"))
    write_model(cameras, images, points, folder, ext)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of dense maps: path, x, y, c, v."""
    from pointloom.operators.rasters import read_dense_blocks, to_pixels

    return to_pixels(read_dense_blocks(spark, path), ["path", "c"]).select("path", "x", "y", "c", "v")
