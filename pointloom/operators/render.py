"""Rendering of a table of splats for one view or a table of views: projection, tiles, compositing, exposure.

A single view enters the plan as literals; of a table of views each meets all splats (they are the question that the splats
are asked), and all their tiles are composited in the same jobs. A splat becomes a row for each tile it touches; these rows
are dealt by ranges of (view, tile, depth) and composited range by range, all pixels of a tile at once. A tile is one row
with arrays over its pixels until the end. Compositing is associative, so a tile that lies in several ranges is put together
from one layer for each.

With ``stop``, a pixel takes no more splats once the next would leave it a transmittance below that. A range ends the work on
a tile when no pixel takes any; of tiles in several ranges, those after the first are composited again with what the ranges
before let through, and left out where that is too little for all pixels. The result is the same however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.functions.harmonics import exposed
from pointloom.functions.maths import Matrix, camera_centre, clamp, covariance, d, projected_covariance, rotation, sigmoid, to_camera
from pointloom.operators.metrics import tiles
from pointloom.session import workers_import, written
from pointloom.sources import files

COLOURS = ["red", "green", "blue"]


@dataclass(frozen=True)
class ViewColumns:
    """A view whose numbers are columns: r is the rotation (array of nine, by rows), t the translation."""

    width: Column
    height: Column
    fx: Column
    fy: Column
    r: Column
    t: Column

    def matrix(self) -> Matrix:
        return [[*(F.get(self.r, F.lit(3 * i + j)) for j in range(3)), F.get(self.t, F.lit(i))] for i in range(3)]


@dataclass(frozen=True)
class View:
    """width and height in pixels, focal lengths, world-to-camera rotation (rows) and translation."""

    width: int
    height: int
    fx: float
    fy: float
    rotation: tuple[tuple[float, float, float], ...] = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    translation: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matrix(self) -> Matrix:
        return [[*(d(v) for v in row), d(t)] for row, t in zip(self.rotation, self.translation, strict=True)]


def project(splats: DataFrame, view: View | ViewColumns, modifier: float = 1.0, low_pass: float = 0.3, near: float = 0.2) -> DataFrame:
    """splats in front of the near plane with px, py, depth, radius and the inverse 2D covariance ca, cb, cc.

    splats: gid, x y z, log scales s0 s1 s2, quaternion q0..q3, and other columns, which stay. low_pass is positive, so the
    inverse exists.
    """
    m, p = view.matrix(), [F.col(c) for c in "xyz"]
    at = to_camera([row[:3] for row in m], [row[3] for row in m], p)
    rows = splats.withColumn("depth", at[2]).filter(F.col("depth") > near)
    cov = [f"_k{k}" for k in range(6)]
    rows = rows.withColumns(dict(zip(cov, covariance([F.exp(f"s{k}") for k in range(3)], rotation(*(F.col(f"q{k}") for k in range(4))), modifier), strict=True)))
    xx, xy, yy, radius = projected_covariance([F.col(c) for c in cov], m, p, d(view.fx), d(view.fy), low_pass)
    rows = rows.withColumns({"px": view.fx * at[0] / F.col("depth") + (view.width - 1) / 2, "py": view.fy * at[1] / F.col("depth") + (view.height - 1) / 2, "_xx": xx, "_xy": xy, "_yy": yy, "radius": radius})
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    rows = rows.withColumn("_det", det)
    inverse = {"ca": F.col("_yy") / F.col("_det"), "cb": -F.col("_xy") / F.col("_det"), "cc": F.col("_xx") / F.col("_det")}
    return rows.withColumns(inverse).drop("_xx", "_xy", "_yy", "_det", *cov)


def coverage(projected: DataFrame, view: View, tile: int = 16, least: float = 1 / 255, cap: float = 0.99) -> DataFrame:
    """A row for each pixel (u, v) where a splat's alpha is ``least`` or more. projected: also opacity before activation."""
    rows = tiles(projected, view.width, view.height, tile)
    one = F.explode(F.sequence(F.lit(0), F.lit(tile * tile - 1)))
    rows = rows.withColumn("_k", one).withColumns({"u": (F.col("tile_x") * tile + F.col("_k") % tile).cast("int"), "v": (F.col("tile_y") * tile + F.floor(F.col("_k") / tile)).cast("int")})
    dx, dy = F.col("u") - F.col("px"), F.col("v") - F.col("py")
    power = -0.5 * (F.col("ca") * dx * dx + F.col("cc") * dy * dy) - F.col("cb") * dx * dy
    alpha = F.least(sigmoid(F.col("opacity")) * F.exp(power), d(cap))
    return rows.filter((F.col("u") < view.width) & (F.col("v") < view.height)).withColumn("alpha", alpha).filter(F.col("alpha") >= least).drop("_k", "tile_x", "tile_y")


class _Tile:
    """The pixels of a tile while splats are added front to back.

    left is what pixels let through, product what they would without a stop; seen sums up weighted values.
    """

    def __init__(self, ty: int, tx: int, tile: int, n: int, start: np.ndarray | None = None):
        self.v, self.u = (g.ravel() for g in np.mgrid[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile])
        self.product = np.ones(tile * tile) if start is None else start
        self.left, self.seen = self.product, np.zeros((n, tile * tile))

    def add(self, x: np.ndarray, least: float, cap: float, stop: float) -> None:
        """x: px, py, ca, cb, cc, alpha and values by splats, nearest first."""
        for at in range(0, x.shape[1], 256):
            if self.product.max() < stop:
                return
            px, py, ca, cb, cc, top = (r[at : at + 256, None] for r in x[:6])
            dx, dy = self.u - px, self.v - py
            alpha = np.minimum(top * np.exp(-0.5 * (ca * dx * dx + cc * dy * dy) - cb * dx * dy), cap)
            alpha[alpha < least] = 0.0
            after = self.product * np.cumprod(1 - alpha, axis=0)
            before = np.concatenate([self.product[None], after[:-1]])
            taken = after >= stop
            self.seen += x[6:, at : at + 256] @ (alpha * before * taken)
            n = taken.sum(axis=0)
            self.left = np.where(n > 0, after[np.maximum(n - 1, 0), np.arange(after.shape[1])], self.left)
            self.product = after[-1]


SHAPE = ["px", "py", "ca", "cb", "cc", "alpha"]


def tile_layers(projected: DataFrame, by: list[str], size: tuple[Column | int, Column | int], values: list[str], tile: int = 16, least: float = 1 / 255, cap: float = 0.99, stop: float = 0.0) -> DataFrame:
    """by, tile_y, tile_x, _range, and arrays over the pixels of the tile: values, transmittance, product. One row for each
    tile and each range of (by, tile, depth, gid) that it lies in; first is the depth and gid of the layer's first splat.

    projected: by, px, py, depth, gid, ca, cb, cc, alpha (the largest one) and values. A task holds one tile's pixels and a
    few splats.
    """
    workers_import(projected.sparkSession)
    order = [*by, "tile_y", "tile_x", "depth", "gid"]
    rows = tiles(projected, *size, tile).select(*order, *SHAPE, *values)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    schema, names = _layer_schema(projected, by, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = pixels = first = None
        for batch in batches:
            keys = [np.asarray(batch.column(c).dictionary_encode().indices) for c in by] + [np.asarray(batch.column(c)) for c in ("tile_y", "tile_x")]
            x = np.stack([np.asarray(batch.column(c)) for c in (*SHAPE, *values)])
            changes = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                mine = tuple(batch.column(c)[a].as_py() for c in (*by, "tile_y", "tile_x", "_range"))
                if here != mine:
                    if here:
                        yield _layer_row(here, pixels, first, names, schema)
                    here, pixels = mine, _Tile(*mine[-3:-1], tile, len(values))
                    first = (batch.column("depth")[a].as_py(), batch.column("gid")[a].as_py())
                pixels.add(x[:, a:b], least, cap, stop)
        if here:
            yield _layer_row(here, pixels, first, names, schema)

    return rows.mapInArrow(run, schema)


def _layer_schema(projected: DataFrame, by: list[str], values: list[str]) -> tuple[T.StructType, list[str]]:
    numbers = T.ArrayType(T.DoubleType())
    keys = [projected.schema[c] for c in by] + [T.StructField(c, T.LongType()) for c in ("tile_y", "tile_x")] + [T.StructField("_range", T.IntegerType())]
    arrays = [T.StructField(c, numbers) for c in (*values, "transmittance", "product")]
    first = T.StructField("first", T.StructType([T.StructField("depth", T.DoubleType()), T.StructField("gid", projected.schema["gid"].dataType)]))
    return T.StructType([*keys, *arrays, first]), [f.name for f in (*keys, *arrays, first)]


def _layer_row(key: tuple, pixels: _Tile, first: tuple, names: list[str], schema: T.StructType) -> pa.RecordBatch:
    row = [*key, *(s.tolist() for s in pixels.seen), pixels.left.tolist(), pixels.product.tolist(), {"depth": first[0], "gid": first[1]}]
    return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], to_arrow_schema(schema))


def _joined(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, values and transmittance of tiles from their layers, nearest first: each shines through those before it."""
    layer = F.struct("_range", *values, "transmittance")
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    over = lambda acc, x: F.struct(*(plus(acc[c], times(acc["transmittance"], x[c])).alias(c) for c in values), times(acc["transmittance"], x["transmittance"]).alias("transmittance"))
    rows = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(layer)).alias("_l"))
    nearest = F.struct(*(F.col("_l")[0][c].alias(c) for c in (*values, "transmittance")))
    more = F.when(F.size("_l") > 1, F.slice("_l", F.lit(2), F.size("_l"))).otherwise(F.slice("_l", 1, 0))
    return rows.select(*keys, F.aggregate(more, nearest, over).alias("_s")).select(*keys, "_s.*")


def _stopped(parts: DataFrame, projected: DataFrame, by: list[str], size: tuple[Column | int, Column | int], values: list[str], tile: int, least: float, cap: float, stop: float) -> DataFrame:
    """What ``_joined`` gives, for layers that were made with a stop."""
    keys = [*by, "tile_y", "tile_x"]
    parts = written(parts, "layers")
    along = Window.partitionBy(*keys).orderBy("_range")  # a tile's rows: one for each range that it lies in
    ends = parts.withColumn("_next", F.lead("first").over(along)).withColumn("_place", F.row_number().over(along))
    through = F.aggregate(F.collect_list("product").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.transform("product", lambda _: d(1.0)), lambda acc, p: F.zip_with(acc, p, lambda x, y: x * y))
    later = ends.withColumn("start", through).filter((F.col("_place") > 1) & F.exists("start", lambda x: x >= stop))
    later = written(later.select(*keys, "_range", "first", F.col("_next").alias("next"), "start"), "later-layers")
    rows = tiles(projected, *size, tile).select(*keys, "depth", "gid", *SHAPE, *values)
    place = F.struct("depth", "gid")
    mine = rows.join(later.drop("start"), keys).filter((place >= F.col("first")) & (F.col("next").isNull() | (place < F.col("next"))))
    mine = mine.select(*keys, "_range", "depth", "gid", *SHAPE, *values)
    schema, names = _layer_schema(projected, by, values)
    group = [*keys, "_range"]

    def again(key: tuple, splats: pa.Table, begun: pa.Table) -> pa.Table:
        splats = splats.sort_by([("depth", "ascending"), ("gid", "ascending")])
        key = tuple(k.as_py() for k in key)
        start = np.array(begun["begun"][0].as_py())
        pixels = _Tile(*key[-3:-1], tile, len(values), start)
        # a pixel that had stopped before keeps what it let through then
        pixels.left = np.where(start >= stop, start, 1.0)
        pixels.add(np.stack([np.asarray(splats[c]) for c in (*SHAPE, *values)]), least, cap, stop)
        return pa.Table.from_batches([_layer_row(key, pixels, (0.0, None), names, schema)])

    begun = later.select(*(F.col(c).alias(f"_of{k}") for k, c in enumerate(group)), F.col("start").alias("begun"))
    redone = mine.groupBy(*group).cogroup(begun.groupBy(*begun.columns[:-1])).applyInArrow(again, schema)
    nearest = ends.filter("_place = 1").select(*keys, *values, "transmittance").unionByName(redone.select(*keys, *values, "transmittance"))
    total = lambda c, f: F.transform(F.sequence(F.lit(0), F.lit(tile * tile - 1)), lambda k: F.aggregate(F.col("_l"), f[0], lambda acc, x: f[1](acc, F.get(x[c], k))))
    rows = nearest.groupBy(*keys).agg(F.collect_list(F.struct(*values, "transmittance")).alias("_l"))
    add, least_of = (d(0.0), lambda a, b: a + b), (d(1.0), F.least)
    return rows.select(*keys, *(total(c, add).alias(c) for c in values), total("transmittance", least_of).alias("transmittance"))


def _pixels(rows: DataFrame, keep: list[str], arrays: list[str], width: Column | int, height: Column | int, tile: int) -> DataFrame:
    """keep, u, v and the numbers of arrays: a row for each pixel of the tiles that lies inside the image."""
    flat = rows.select(*keep, "tile_y", "tile_x", F.posexplode(F.arrays_zip(*arrays)).alias("_k", "_p"), d(width).alias("_w"), d(height).alias("_h"))
    u, v = F.col("tile_x") * tile + F.col("_k") % tile, F.col("tile_y") * tile + F.floor(F.col("_k") / tile)
    flat = flat.withColumns({"u": u.cast("int"), "v": v.cast("int")}).filter((F.col("u") < F.col("_w")) & (F.col("v") < F.col("_h")))
    return flat.select(*keep, "u", "v", *(F.col(f"_p.{c}").alias(c) for c in arrays))


def layers(projected: DataFrame, view: View, values: list[str], tile: int = 16, least: float = 1 / 255, cap: float = 0.99) -> DataFrame:
    """u, v, _range, values and transmittance: a row for each pixel and each range of (tile, depth, gid) that its tile lies in."""
    parts = tile_layers(projected, [], (view.width, view.height), values, tile, least, cap)
    return _pixels(parts, ["_range"], [*values, "transmittance"], view.width, view.height, tile)


VALUES = [*COLOURS, "inverse_depth"]
# written: the optimizer would copy the projection's expressions into each filter on what is computed from them
PROJECTED = ["gid", "px", "py", "depth", "radius", "ca", "cb", "cc", "alpha", *VALUES]


def _image(projected: DataFrame, frames: DataFrame, by: list[str], background: tuple[float, float, float], stop: float, tile: int = 16) -> DataFrame:
    """by, u, v, colours over the background, inverse_depth and transmittance for all pixels of frames (by, width, height)."""
    size = (F.col("width"), F.col("height"))
    parts = tile_layers(projected, by, size, VALUES, tile, stop=stop)
    keys = [*by, "tile_y", "tile_x"]
    seen = _stopped(parts, projected, by, size, VALUES, tile, 1 / 255, 0.99, stop) if stop > 0 else _joined(parts, keys, VALUES)
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(c) - 1) / tile)))
    grid = frames.select(*by, *size, span("height").alias("tile_y")).select("*", span("width").alias("tile_x"))
    empty = F.array_repeat(d(0.0), tile * tile)
    rows = grid.join(seen, keys, "left").withColumns({c: F.coalesce(c, empty) for c in VALUES} | {"transmittance": F.coalesce("transmittance", F.array_repeat(d(1.0), tile * tile))})
    shown = _pixels(rows, by, [*VALUES, "transmittance"], *size, tile)
    return shown.withColumns({c: F.col(c) + b * F.col("transmittance") for c, b in zip(COLOURS, background, strict=True)})


def render(splats: DataFrame, view: View, background: tuple[float, float, float] = (0.0, 0.0, 0.0), exposure: list[list[float]] | None = None, modifier: float = 1.0, low_pass: float = 0.3, stop: float = 0.0) -> DataFrame:
    """Every pixel (u, v) of a view: red, green, blue within 0..1, inverse depth, transmittance.

    splats also have opacity and the colours seen from the view. Pixels that nothing covers show the background. With stop 0
    splats are composited to the last one.
    """
    rows = project(splats, view, modifier, low_pass).withColumn("alpha", sigmoid(F.col("opacity"))).withColumn("inverse_depth", 1 / F.col("depth"))
    projected = written(rows.select(*PROJECTED), "projected").withColumns({"width": F.lit(view.width), "height": F.lit(view.height)})
    frame = splats.sparkSession.range(1).select(F.lit(view.width).alias("width"), F.lit(view.height).alias("height"))
    shown = _image(projected, frame, [], background, stop)
    rgb = [F.col(c) for c in COLOURS]
    if exposure is not None:
        rgb = exposed(rgb, [[d(x) for x in row] for row in exposure])
    return shown.select("u", "v", *(clamp(x, 0.0, 1.0).alias(c) for x, c in zip(rgb, COLOURS, strict=True)), "inverse_depth", "transmittance")


def render_views(
    splats: DataFrame,
    views: DataFrame,
    key: str,
    background: tuple[float, float, float] = (0.0, 0.0, 0.0),
    colours: Callable[[list[Column]], list[Column]] | None = None,
    exposure: str | None = None,
    modifier: float = 1.0,
    low_pass: float = 0.3,
    stop: float = 0.0,
) -> DataFrame:
    """Every pixel (key, u, v) of every view of a table, as ``render`` gives them, in the same few jobs for all views.

    views: key (one row each), width, height, fx, fy, r and t (see ViewColumns). colours makes the colours of a splat from the
    columns of the camera's centre; without it splats have them. exposure names a column of views with a 3 x 4 matrix, the
    identity where it is NULL. Views without any splat show the background. Only splats that touch a view's image are kept
    for it.
    """
    frames = written(views.select(F.col(key).alias("view"), *(F.col(c) for c in ("width", "height", "fx", "fy", "r", "t")), *([F.col(exposure).alias("exposure")] if exposure else [])), "views")
    asked = frames.select("view", *(F.col(c).alias(f"_{c}") for c in ("width", "height", "fx", "fy", "r", "t")))
    view = ViewColumns(*(F.col(f"_{c}") for c in ("width", "height", "fx", "fy", "r", "t")))
    rows = project(splats.crossJoin(asked), view, modifier, low_pass)  # the planner knows the size of the views
    if colours:
        rows = rows.withColumns(dict(zip(COLOURS, colours(camera_centre(view.matrix())), strict=True)))
    # generated: a filter on plain columns would take a copy of all expressions behind them
    made = ["px", "py", "radius", "ca", "cb", "cc"]
    rows = rows.select("view", "_width", "_height", "gid", "depth", "opacity", *COLOURS, F.inline(F.array(F.struct(*made))))
    inside = [(F.col(c) + F.col("radius") >= 0) & (F.col(c) - F.col("radius") < size) for c, size in (("px", view.width), ("py", view.height))]
    rows = rows.filter(inside[0] & inside[1]).withColumn("alpha", sigmoid(F.col("opacity"))).withColumn("inverse_depth", 1 / F.col("depth"))
    projected = written(rows.select("view", view.width.alias("width"), view.height.alias("height"), *PROJECTED), "projected")
    shown = _image(projected, frames, ["view"], background, stop)
    if exposure:
        shown = shown.join(frames.select("view", "exposure"), "view")
        m = [[F.coalesce(F.col("exposure")[i][j], d(float(i == j))) for j in range(4)] for i in range(3)]
        shown = shown.withColumns(dict(zip(COLOURS, exposed([F.col(c) for c in COLOURS], m), strict=True)))
    return shown.select(F.col("view").alias(key), "u", "v", *(clamp(F.col(c), 0.0, 1.0).alias(c) for c in COLOURS), "inverse_depth", "transmittance")


def write_views(shown: DataFrame, path: Column, folder: str) -> DataFrame:
    """Every rendered view as a PNG below folder at its path (a column of shown's key); path and bytes, a row a view."""
    rows = shown.select(path.alias("path"), F.col("v").alias("y"), F.col("u").alias("x"), F.posexplode(F.array(*COLOURS)).alias("c", "v"))
    return files.write_images(files.encode_png(rows, ["path"]), folder)
