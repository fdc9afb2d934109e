"""Image metrics over pixel relations, losses and their roll-ups.

A pixel relation has keys (such as scene, method, image), c, y, x and v in 0..1; pairs have a and b instead of v.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pointloom.functions.maths import d, gaussian_window
from pointloom.operators import rasters
from pointloom.session import workers_import, written


def pairs(renders: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of both images; see ``unpaired`` for images that only one side has."""
    on = [*keys, "c", "y", "x"]
    return renders.withColumnRenamed("v", "a").join(truth.select(*on, F.col("v").alias("b")), on)


def unpaired(renders: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    a, b = renders.select(*keys).distinct(), truth.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing", F.lit("truth")).unionByName(b.join(a, keys, "left_anti").withColumn("missing", F.lit("render")))


def psnr(mse: Column) -> Column:
    """20 log10(1 / sqrt(mse)); infinite for equal images."""
    return F.when(mse == 0, d(math.inf)).otherwise(-10 * F.log10(F.nullif(mse, d(0.0))))


def errors(both: DataFrame, by: list[str]) -> DataFrame:
    """l1, mse and psnr by image, or by image and channel, as ``by`` says."""
    diff = F.col("a") - F.col("b")
    return both.groupBy(*by).agg(F.avg(F.abs(diff)).alias("l1"), F.avg(diff * diff).alias("mse")).withColumn("psnr", psnr(F.col("mse")))


def channel_psnr(both: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over channels of each channel's PSNR, the other convention in use."""
    return errors(both, [*keys, "c"]).groupBy(*keys).agg(F.avg("psnr").alias("psnr_channels"))


def _blurred(plane: np.ndarray, window: list[float]) -> np.ndarray:
    """A separable stencil, zeros beyond the border."""
    r = len(window) // 2
    for _ in range(2):
        wide = np.pad(plane, ((r, r), (0, 0)))
        plane = sum(w * wide[k : k + len(plane)] for k, w in enumerate(window)).T
    return plane


def ssim(both: DataFrame, keys: list[str], size: int = 11, sigma: float = 1.5, tile: int = 256) -> DataFrame:
    """Structural similarity by image: a separable Gaussian stencil, zeros beyond the border and for missing pixels.

    Planes are cut into tiles with as many of their neighbours' pixels around them as the stencil reaches, so a task holds
    one tile of an image of any size; tiles give sums. Images are means over the pixels of all their channels, those of a
    channel being the rectangle that its pixels reach. Where neither image has a pixel in reach, they are alike.
    """
    workers_import(both.sparkSession)
    w, r = gaussian_window(size, sigma), size // 2

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        row, col = key[1].as_py(), key[2].as_py()
        size = min(tile, rows["height"][0].as_py() - row * tile), min(tile, rows["width"][0].as_py() - col * tile)
        a, b = (rasters.plane(rows, v, row, col, tile, r, r, 0.0, size) for v in "ab")
        ma, mb, aa, bb, ab = (_blurred(p, w)[r : r + size[0], r : r + size[1]] for p in (a, b, a * a, b * b, a * b))
        aa, bb, ab = aa - ma * ma, bb - mb * mb, ab - ma * mb
        value = (2 * ma * mb + 1e-4) * (2 * ab + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (aa + bb + 9e-4))
        return pa.table([*([key[0].as_py()[k]] for k in keys), [float(value.sum())], [value.size]], schema=out)

    schema = StructType([*(both.schema[k] for k in keys), StructField("_total", DoubleType()), StructField("_n", LongType())])
    out = to_arrow_schema(schema)
    rows = both.select(F.struct(*keys, "c").alias("_key"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(v).cast("double").alias(v) for v in "ab"))
    frames = rows.groupBy("_key").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))  # a row a channel
    near = rasters.dealt(rows, tile, r, r).join(frames, "_key").filter((F.col("row") * tile < F.col("height")) & (F.col("col") * tile < F.col("width")))
    sums = near.groupBy("_key", "row", "col").applyInArrow(one, schema)
    whole = frames.select(*(F.col("_key")[k].alias(k) for k in keys), F.lit(0.0).alias("_total"), F.lit(0).cast("long").alias("_n"), (F.col("height").cast("long") * F.col("width")).alias("_all"))
    every = sums.withColumn("_all", F.lit(0).cast("long")).unionByName(whole).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("_total", "_n", "_all")))
    return every.select(*keys, ((F.col("_total") + F.col("_all") - F.col("_n")) / F.col("_all")).alias("ssim"))


def feature_distance(features: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Perceptual distance from given backbone features.

    features: keys, layer, y, x and arrays fa, fb, weight over channels. Features are scaled to unit norm, squared
    differences weighted, averaged over places and summed over layers.
    """
    def unit(c: str) -> Column:
        n = F.sqrt(F.aggregate(c, d(0.0), lambda acc, v: acc + v * v)) + eps
        return F.transform(c, lambda v: v / n)

    diff = F.zip_with(unit("fa"), unit("fb"), lambda a, b: (a - b) * (a - b))
    here = F.aggregate(F.zip_with(diff, "weight", lambda x, w: x * w), d(0.0), lambda acc, v: acc + v)
    layer = features.groupBy(*keys, "layer").agg(F.avg(here).alias("_d"))
    return layer.groupBy(*keys).agg(F.sum("_d").alias("distance"))


def roll_up(per_view: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Unweighted means over images."""
    return per_view.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics))


def nested(per_view: DataFrame, by: str, image: str, metrics: list[str]) -> DataFrame:
    """{method: {metric: {image: value}}} as JSON, a string for each method."""
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.struct(image, m)))).alias(m) for m in metrics]
    return per_view.groupBy(by).agg(*maps).select(by, F.to_json(F.struct(*metrics)).alias("json"))


def total_loss(l1: Column, ssim_: Column, depth: Column, depth_weight: Column, mix: float = 0.2) -> Column:
    return (1 - mix) * l1 + mix * (1 - ssim_) + depth_weight * depth


def affine_scan(x: pa.Array, new: np.ndarray, keep: float, gain: float, start: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """e[i] = keep e[i - 1] + gain x[i], from 0 where new, from start where the first row is not new (None: NULL before).

    Gives e, whether it is NULL (from the first NULL x of a run on), and each row's place in its run from 1 on. Steps of the
    scan double the rows that a result covers: affine maps are composed with those 1, 2, 4, ... rows before.
    """
    at = np.arange(len(x))
    first = np.maximum.accumulate(np.where(new, at, 0))
    missing = np.asarray(x.is_null())
    b = gain * np.asarray(pc.fill_null(x, 0.0)).astype(float)
    a = np.where(new, 0.0, keep)
    broken = np.maximum.accumulate(np.where(missing, at, -1)) >= first
    if not new[0]:
        if start is None:
            broken |= np.cumsum(new) == 0
        else:
            b[0] += keep * start
        a[0] = 0.0
    shift, longest = 1, int((at - first).max()) + 1
    while shift < longest:
        on = np.flatnonzero(a[shift:]) + shift
        b[on] = b[on] + a[on] * b[on - shift]
        a[on] = a[on] * a[on - shift]
        shift *= 2
    return b, broken, at - first + 1


def smoothed(rows: DataFrame, by: list[str], order: list[str], value: str, keep: float = 0.6) -> DataFrame:
    """Exponential moving average e = (1 - keep) x + keep e before, from 0, in the order of a group's rows.

    Rows are dealt by ranges of (by, order) and scanned range by range, in whole arrays. A scan is linear in its start, so
    what a group has at the end of earlier ranges is added with keep to the power of the rows since. After a NULL value e is
    NULL.
    """
    workers_import(rows.sparkSession)
    dealt = rows.select(*by, *order, F.col(value).cast("double").alias("_x")).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id())

    def fold(batches):
        last, e, n = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.asarray(pc.fill_null(batch.column(c).dictionary_encode().indices, -1)) for c in by]
            key = lambda k: tuple(batch.column(c)[k].as_py() for c in by)  # noqa: B023, E731
            new = np.any([np.r_[True, i[1:] != i[:-1]] for i in ids], axis=0) if by else np.arange(batch.num_rows) == 0
            new[0] = last is None or key(0) != last
            es, broken, place = affine_scan(batch.column("_x"), new, keep, 1 - keep, e)
            ns = place + (0 if new[0] else n * (np.cumsum(new) == 0))
            last, e, n = key(batch.num_rows - 1), None if broken[-1] else float(es[-1]), int(ns[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, *order, "_range")), pa.array(es, mask=broken), pa.array(ns)], [*by, *order, "_range", "_e", "_n"])

    fields = {f.name: f for f in dealt.schema.fields}
    schema = StructType([*(fields[c] for c in (*by, *order, "_range")), StructField("_e", DoubleType()), StructField("_n", LongType())])
    folded = written(dealt.mapInArrow(fold, schema), "folded")
    # a row for each range of a group: those of one group are no more than there are ranges
    ends = folded.groupBy(*by, "_range").agg(F.max(F.struct("_n", "_e")).alias("_end"))
    each = ends.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_range", F.col("_end._n").alias("n"), F.col("_end._e").alias("e")))).alias("_ends")).filter(F.size("_ends") > 1)
    start = F.struct(d(0.0).alias("e"), F.array().cast("array<double>").alias("all"))
    carried = F.aggregate("_ends", start, lambda acc, t: F.struct((t["e"] + F.pow(d(keep), t["n"]) * acc["e"]).alias("e"), F.concat(acc["all"], F.array(acc["e"])).alias("all")))["all"]
    carry = each.select(*by, F.explode(F.arrays_zip(F.col("_ends._range").alias("r"), carried.alias("e"))).alias("_z"))
    carry = carry.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_z.r").alias("_r"), F.col("_z.e").alias("_before"), F.lit(True).alias("_later"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    # a group goes on into a range only as its first, so carry has at most two rows for each range
    joined = folded.join(F.broadcast(carry), functools.reduce(lambda a, b: a & b, same, F.col("_range") == F.col("_r")), "left")
    return joined.select(*by, *order, F.when(F.col("_later"), F.col("_e") + F.pow(d(keep), F.col("_n")) * F.col("_before")).otherwise(F.col("_e")).alias("ema"))


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts of values of 0..1 in equal bins; 1 is in the last."""
    return rows.groupBy(F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def first_k(rows: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; the ranking is cut to k before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(rank, place).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def z_score(value: Column, mean: float, deviation: float) -> Column:
    """A channel as backbones take it."""
    return (value - mean) / deviation


def elapsed(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Wall seconds of each suite: from its first start to its last end, and the sum of its runs. One pass."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    return rows.groupBy(*by).agg((F.max(seconds(end)) - F.min(seconds(start))).alias("elapsed"), F.sum(seconds(end) - seconds(start)).alias("busy"), F.count("*").alias("runs"))


def composite(hits: DataFrame, pixel: list[str], channels: list[str], background: float = 0.0, cap: float = 0.99) -> DataFrame:
    """Front-to-back compositing: hits (pixel, depth, gid, alpha, channels) to one row a pixel.

    Transmittance before a hit is the product of 1 - alpha of those nearer, of equal depth those of smaller gid.
    """
    alpha = F.least(F.col("alpha"), d(cap))
    order = Window.partitionBy(*pixel).orderBy("depth", "gid")
    log_left = F.coalesce(F.sum(F.ln(1 - alpha)).over(order.rowsBetween(Window.unboundedPreceding, -1)), d(0.0))
    rows = hits.withColumn("_weight", alpha * F.exp(log_left)).withColumn("_left", F.ln(1 - alpha))
    out = rows.groupBy(*pixel).agg(*(F.sum(F.col("_weight") * F.col(c)).alias(c) for c in channels), F.exp(F.sum("_left")).alias("transmittance"))
    return out.withColumns({c: F.col(c) + background * F.col("transmittance") for c in channels})


def tiles(splats: DataFrame, width: Column | int, height: Column | int, tile: int = 16) -> DataFrame:
    """A row for each tile that a splat's square (px, py, radius) touches."""
    rows = splats.filter("radius > 0")

    def span(centre: str, size: Column | int) -> Column:
        last = F.floor((d(size) - 1) / tile)
        low = F.greatest(F.floor((F.col(centre) - F.col("radius")) / tile), F.lit(0))
        high = F.least(F.floor((F.col(centre) + F.col("radius")) / tile), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return rows.withColumn("tile_x", F.explode(span("px", width))).withColumn("tile_y", F.explode(span("py", height)))
