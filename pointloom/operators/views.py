"""Splits, lookups and joins of views, points and parameters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.maths import d, inverse_depth, to_camera
from pointloom.functions.permute import place
from pointloom.functions.text import numbered, stem
from pointloom.session import written


def global_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """0-based position in a total order, without one task that sees all rows.

    Rows are dealt by ranges and written out with their range's number; counts of earlier ranges (one row a range) are
    added to the position inside the range.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    starts = sizes.select("_range", before.alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(starts), "_range").withColumn(out, (inside + F.col("_before")).cast("long")).drop("_range", "_before")


def hold_out_step(folder: str, every: int = 8) -> int:
    """Each which view is held out: 8 for folders with 360 in their name, else as asked; 0 leaves it to a list of names."""
    return 8 if "360" in folder else every


def hold_out(views: DataFrame, order: list[str], every: int = 8) -> DataFrame:
    """views with idx and is_test: each every-th one by name; none when every is 0."""
    rows = global_index(views, order)
    return rows.withColumn("is_test", (F.col("idx") % every == 0) if every else F.lit(False))


def listed(views: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """views with is_test: whether a list holds their name."""
    found = names.select(F.trim(F.col(name)).alias("_listed")).distinct()
    return views.join(found, views[name] == F.col("_listed"), "left").withColumn("is_test", F.col("_listed").isNotNull()).drop("_listed")


def splits(views: DataFrame, overlap: bool = False) -> DataFrame:
    """Train and test rows with their split; with overlap test views train, too."""
    train = views if overlap else views.filter(~F.col("is_test"))
    return train.withColumn("split", F.lit("train")).unionByName(views.filter("is_test").withColumn("split", F.lit("test")))


def with_camera(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """images with their camera; a missing one is an error."""
    joined = images.join(cameras.withColumn("_known", F.lit(True)), "camera_id", "left")
    known = F.when(F.col("_known"), F.col("camera_id")).otherwise(F.raise_error(F.concat(F.lit("no camera "), F.col("camera_id").cast("string"))).cast("int"))
    return joined.withColumn("camera_id", known).drop("_known")


def focal_lengths(model: Column, params: Column) -> tuple[Column, Column]:
    """fx, fy of the two admitted camera models; others are an error."""
    refused = F.raise_error(F.concat(F.lit("camera model not supported: "), model)).cast("double")
    fx = F.when(model.isin("SIMPLE_PINHOLE", "PINHOLE"), F.get(params, F.lit(0))).otherwise(refused)
    fy = F.when(model == "SIMPLE_PINHOLE", F.get(params, F.lit(0))).when(model == "PINHOLE", F.get(params, F.lit(1))).otherwise(refused)
    return fx, fy


def with_params(views: DataFrame, params: DataFrame, name: str = "name") -> DataFrame:
    """views with the parameters of their stem, NULL where there are none."""
    return views.withColumn("stem", stem(F.col(name))).join(params, "stem", "left")


def observations(images: DataFrame, points: DataFrame) -> DataFrame:
    """Observations with their point. Ids beyond the largest known one are left out; gaps below it are points at 0, 0, 0."""
    seen = images.select("image_id", F.explode("points2d").alias("p")).select("image_id", "p.x", "p.y", "p.point3d_id").filter("point3d_id >= 0")
    top = points.agg(F.max("point3d_id").alias("_top"))  # one row
    seen = seen.join(F.broadcast(top), F.col("point3d_id") <= F.col("_top")).drop("_top")
    at = points.select("point3d_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.lit(True).alias("_known"))
    out = seen.join(at, "point3d_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), d(0.0)) for c in ("px", "py", "pz")}).withColumn("gap", F.col("_known").isNull()).drop("_known")


def observed_depth(seen: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Observations with invdepth (of the point in the view) and valid: inside the image and in front of the camera.

    seen: what ``observations`` gives, with the view's rotation r (array of nine, by rows) and translation t (array of three).
    """
    z = to_camera([[F.get("r", F.lit(3 * i + j)) for j in range(3)] for i in range(3)], [F.get("t", F.lit(i)) for i in range(3)], [F.col(c) for c in ("px", "py", "pz")])[2]
    rows = seen.withColumn("invdepth", inverse_depth(z))
    return rows.withColumn("valid", F.coalesce((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height) & (F.col("invdepth") > 0), F.lit(False)))


def as_of(frames: DataFrame, poses: DataFrame, by: list[str], time: str, ident: str, values: list[str], tolerance: int | None = None) -> DataFrame:
    """frames with the values of the last pose at or before them; of poses at one time the largest ident counts.

    One union, dealt by ranges of (by, time). Each range finds the last pose within itself; the last one before it comes from
    a row for each key and range, so a capture of any length is spread over tasks. Frames without a pose are left out, as
    are those farther than tolerance.
    """
    pose = F.struct(F.col(time).alias("_at"), *(F.col(v) for v in values))
    rows = frames.withColumns({"_pose": F.lit(None).cast(poses.select(pose.alias("p")).schema["p"].dataType), "_kind": F.lit(1)}).unionByName(
        poses.select(*by, time, ident, pose.alias("_pose"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    order = [time, "_kind", ident]
    rows = written(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "poses")
    known = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "_range").agg(F.max_by("_pose", F.when(F.col("_pose").isNotNull(), F.struct(*order))).alias("_end"))
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(known)).filter(F.col("_before").isNotNull())
    # a key goes on into a range only as its first: one row for each range at most
    before = before.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_here"), "_before")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.col("_range") == F.col("_here"))
    inside = F.last("_pose", ignorenulls=True).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_inside", inside).filter(F.col("_kind") == 1).join(F.broadcast(before), same, "left")
    out = out.withColumn("_last", F.coalesce("_inside", "_before")).filter(F.col("_last").isNotNull())
    if tolerance is not None:
        out = out.filter(F.col(time) - F.col("_last._at") <= tolerance)
    return out.select(*frames.columns, F.col("_last._at").alias("pose_time"), *(F.col(f"_last.{v}").alias(v) for v in values))


def capture_frames(frames: DataFrame, poses: DataFrame, by: list[str], time: str, ident: str, values: list[str], tolerance: int | None = None) -> DataFrame:
    """Frames of a capture that have a pose, with dense image ids from 1 on in order of time, and file names."""
    posed = global_index(as_of(frames, poses, by, time, ident, values, tolerance), [*by, time, ident], "image_id")
    return posed.withColumn("image_id", F.col("image_id") + 1).withColumn("name", numbered(F.col("image_id")))


def with_exposure(views: DataFrame, exposures: DataFrame, name: str = "image_name") -> DataFrame:
    """views with the 3 x 4 exposure of their name, the identity where there is none."""
    identity = F.array(*(F.array(*(d(float(i == j)) for j in range(4))) for i in range(3)))
    return views.join(exposures.select(name, "m"), name, "left").withColumn("m", F.coalesce("m", identity))


def validation_views(train: DataFrame, test: DataFrame, order: list[str], first: int = 5, last: int = 30, step: int = 5) -> DataFrame:
    """All test views, and the training views at places first, first + step, ... below last, modulo their number."""
    rows = global_index(train, order)
    n = rows.agg(F.count("*").alias("_n"))  # one row
    places = F.transform(F.sequence(F.lit(first), F.lit(last - 1), F.lit(step)), lambda k: F.pmod(k.cast("long"), F.col("_n")))
    picked = rows.join(F.broadcast(n)).filter(F.array_contains(places, F.col("idx"))).drop("idx", "_n")
    return picked.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def override(command: dict, saved: dict) -> dict:
    """Saved settings, overridden by those given on the command line that are not None."""
    return saved | {k: v for k, v in command.items() if v is not None}


def half(pixels: DataFrame, width: Column, right: bool = True) -> DataFrame:
    """The right (or left) half of images."""
    cut = F.floor(width / 2)
    return pixels.filter(F.col("x") >= cut if right else F.col("x") < cut)


def masked(value: Column, alpha: Column) -> Column:
    return value * F.coalesce(alpha, d(1.0))


def lit_mask(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x and mask: whether a pixel has any light in any channel, as for rectified captures with black borders."""
    return pixels.groupBy(*by, "y", "x").agg((F.max("v") > 0).alias("mask"))


def _draw(seed: int, *parts: Column) -> Column:
    """A pseudo-random key, the same for the same seed and parts whatever the partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int = 0, place: str = "place") -> DataFrame:
    """df with each row's place in a fixed pseudo-random order."""
    return global_index(df.withColumn("_h", _draw(seed, F.col(key))), ["_h", key], place).drop("_h")


def epoch_slots(iterations: DataFrame, n: int) -> DataFrame:
    """iterations (it) with epoch and slot: sampling without replacement takes every view once an epoch."""
    return iterations.withColumn("epoch", F.floor(F.col("it") / n)).withColumn("slot", F.col("it") % n)


def epoch_order(views: DataFrame, epochs: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """epoch, slot and key: in which slot of each epoch a view is drawn, without replacement, in a fixed pseudo-random order.

    Views are put in order by key once; slots come by formula (``permute``), so nothing sorts epochs times views, which are
    the rows of the answer. epochs (epoch) are a table of its own, crossed as the planner sees fit.
    """
    rows = written(global_index(views.select(key), [key], "_view"), "views")
    n = rows.count()
    drawn = rows.crossJoin(written(epochs.select("epoch").distinct(), "epochs"))
    return drawn.select("epoch", place(F.col("_view"), F.col("epoch"), n, seed, back=True).alias("slot"), key)


def training_log(iterations: DataFrame, views: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """iterations (it) with epoch, slot and the key of the view that is drawn: every view once an epoch, without sorting epochs.

    A row finds its view by the permutation's formula and one join on the view's place.
    """
    rows = written(global_index(views.select(key), [key], "_view"), "views")
    n = rows.count()
    if not n:
        raise ValueError("no views to draw from")
    log = epoch_slots(iterations, n)
    return log.withColumn("_view", place(F.col("slot"), F.col("epoch"), n, seed)).join(rows, "_view").drop("_view")


def paired(scenes: DataFrame, sources: DataFrame, order: str = "place") -> DataFrame:
    """Scenes with the source of the same place in their list; a list that is longer than the other is cut to it."""
    a, b = global_index(scenes, [order], "_pair"), global_index(sources, [order], "_pair")
    return a.drop(order).join(b.drop(order), "_pair").withColumnRenamed("_pair", order)


def triggers(iterations: DataFrame, densify: tuple[int, int, int] = (500, 15_000, 100), reset: int = 3000, ramp: int = 1000, white: bool = False) -> DataFrame:
    """Which periodic actions an iteration (it) calls for."""
    it, (first, last, every) = F.col("it"), densify
    active = it < last
    again = (it % reset == 0) | ((it == first) if white else F.lit(False))
    return iterations.select(
        *iterations.columns, (it % ramp == 0).alias("raise_degree"), (active & (it > first) & (it % every == 0)).alias("densify"), (active & again).alias("reset_opacity"),
        F.when(it > reset, F.lit(20)).cast("int").alias("size_limit"),
    )
