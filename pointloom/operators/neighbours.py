"""Exact nearest neighbours by a packed tree along a space-filling curve.

Equal positions become one row with their number. Positions are put in order along a Z-curve over quantiles of each axis, so
far outliers do not thin the curve out where the others are. Blocks are ``block`` positions that follow each other, however
unevenly they lie, with their box; ``FAN`` boxes that follow each other are a node of the next level, up to one root.

Its own block bounds a position's k-th distance. Then the levels are walked from the root, all positions at once: a position
and a node meet by equality of the node's number, and go on to those children whose box is no farther than the bound. What
a box proves needs no curve, so results are exact whatever the order. The farthest corner of a near block tightens the bound
once more, and what is left is searched. A position and a block give at most k distances, and a ranking that is cut to k
before the shuffle keeps the k smallest of all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pointloom.functions.maths import d
from pointloom.operators.views import global_index
from pointloom.session import workers_import, written


def _apart2(gaps: list[Column]) -> Column:
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


#: Children of a node, and bits of an axis in the curve.
FAN, BITS = 64, 10


def _near2(box: Callable[[str], Column] = F.col) -> Column:
    """The squared distance to a box, never above that to a position in it: it is summed in the same order."""
    return _apart2([F.greatest(box(f"low_{c}") - F.col(c), d(0.0), F.col(c) - box(f"high_{c}")) for c in "xyz"])


def _far2() -> Column:
    return _apart2([F.greatest(F.abs(F.col(c) - F.col(f"low_{c}")), F.abs(F.col(c) - F.col(f"high_{c}"))) for c in "xyz"])


def _nearest(k: int) -> Column:
    """The k smallest squared distances from pid, x, y, z to other points of members, in order."""
    others = F.transform("members", lambda o: F.struct(_apart2([F.col(c) - o[c] for c in "xyz"]).alias("d2"), F.least(F.lit(k), o["m"] - (o["pid"] == F.col("pid")).cast("long")).cast("int").alias("n")))
    return F.slice(F.sort_array(F.flatten(F.transform(others, lambda o: F.array_repeat(o["d2"], o["n"])))), 1, k)


def curve(at: DataFrame) -> DataFrame:
    """at (x, y, z) with curve, the place on a Z-curve over 2 ** BITS quantiles of each axis. The quantiles are approximate
    and few; they decide on the order only."""
    workers_import(at.sparkSession)
    some = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    cuts = [np.array(q) for q in at.approxQuantile(list("xyz"), some, 0.25 / (1 << BITS))]

    def run(batches):
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            for axis, c in enumerate("xyz"):
                place = np.searchsorted(cuts[axis], batch.column(c).to_numpy(zero_copy_only=False), "right")
                for bit in range(BITS):
                    key |= (place >> bit & 1) << 3 * bit + axis
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(key)], [*batch.schema.names, "curve"])

    return at.mapInArrow(run, StructType([*at.schema.fields, StructField("curve", LongType())]))


def levels(blocks: DataFrame, n: int) -> list[DataFrame]:
    """node and children (node and box each) of the levels above n blocks, lowest first, up to a single node 0."""
    out, boxes = [], blocks.select(F.col("block").alias("node"), *(f"{n}_{c}" for c in "xyz" for n in ("low", "high")))
    while True:
        child = F.struct(*boxes.columns)
        box = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]
        nodes = written(boxes.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.collect_list(child).alias("children"), *box), "nodes")
        out.append(nodes.select(F.col("up").alias("node"), "children"))
        boxes, n = nodes.drop("children").withColumnRenamed("up", "node"), -(-n // FAN)
        if n <= 1:
            return out


def mean_distance2(points: DataFrame, k: int = 3, block: int = 32) -> DataFrame:
    """gid and dist2, the mean squared distance to the k nearest other points. points: gid, x, y, z.

    With k points or fewer the mean is over those that exist; a single point has 0. Points without a finite position are
    nobody's neighbours and have NULL.
    """
    points = points.select("gid", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    known = F.coalesce((F.abs("x") < math.inf) & (F.abs("y") < math.inf) & (F.abs("z") < math.inf), F.lit(False))
    at = written(points.filter(known).groupBy(*"xyz").agg(F.count("*").alias("m")), "positions")
    size = at.agg(F.count("*").alias("places"), F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()
    k_here = min(k, size["n"] - 1)
    if k_here < 1:
        return points.select("gid", F.when(known, d(0.0)).alias("dist2"))
    at = written(global_index(curve(at), ["curve", *"xyz"], "pid").withColumn("block", F.floor(F.col("pid") / block)), "blocks")
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    blocks = written(at.groupBy("block").agg(F.collect_list(F.struct("pid", *"xyz", "m")).alias("members"), F.sum("m").alias("held"), *box), "block-rows")
    members = blocks.select("block", "members")
    best = at.filter(F.col("m") <= k_here).join(members, "block").select("pid", *"xyz", _nearest(k_here).alias("best"))
    asked = written(best.select("pid", *"xyz", F.when(F.size("best") == k_here, F.element_at("best", -1)).otherwise(d(math.inf)).alias("bound2"), F.lit(0).cast("long").alias("node")), "asked")
    near, ask = asked, ["pid", *"xyz", "bound2"]
    for nodes in reversed(levels(blocks, -(-size["places"] // block))):
        inside = F.filter("children", lambda c: _near2(lambda n: c[n]) <= F.col("bound2"))
        near = near.join(nodes, "node").select(*ask, F.explode(inside).alias("_c")).select(*ask, F.col("_c.node").alias("node"))
    near = near.withColumnRenamed("node", "block").join(blocks.drop("members"), "block")
    near = written(near.select(*ask, "block", _near2().alias("near2"), F.when(F.col("held") > k_here, _far2()).alias("far2")), "near-blocks")
    tight = near.groupBy("pid").agg(F.min("far2").alias("tight2"))
    left = near.join(tight, "pid").filter(F.col("near2") <= F.least("bound2", "tight2"))
    hits = left.join(members, "block").select("pid", F.explode(_nearest(k_here)).alias("d2"))
    top = hits.withColumn("_n", F.row_number().over(Window.partitionBy("pid").orderBy("d2"))).filter(F.col("_n") <= k_here)
    found = top.groupBy("pid").agg((F.sum("d2") / k_here).alias("dist2"))
    placed = written(at.join(found, "pid", "left").select(*"xyz", F.coalesce("dist2", d(0.0)).alias("dist2")), "neighbours")
    out = points.filter(known).join(placed, [*"xyz"]).select("gid", "dist2")
    return out.unionByName(points.filter(~known).select("gid", F.lit(None).cast("double").alias("dist2")))


def _product(q: tuple[int, ...], left: bool) -> np.ndarray:
    """Matrix of the product of quaternions q * x (left) or x * q, on x as (w, x, y, z)."""
    w, v, side = q[0], np.array(q[1:]), 1 if left else -1
    out = w * np.eye(4)
    out[0, 1:] -= v
    out[1:, 0] += v
    out[1:, 1:] += side * np.cross(v, np.eye(3)).T
    return out


def rotation_forms() -> np.ndarray:
    """A with rotation(q)[i, j] = q A[i, j] q for a unit quaternion q.

    Entry i, j is the part along e_i of q e_j q*, which is the scalar product of e_i q and q e_j.
    """
    units = [tuple(int(k == i) for k in range(4)) for i in (1, 2, 3)]
    return np.array([[_product(a, True).T @ _product(b, False) for b in units] for a in units])


def rotation_quaternions(df: DataFrame, matrix: str = "r", out: str = "q") -> DataFrame:
    """Quaternions (w, x, y, z), w >= 0, of rotation matrices (arrays of nine, by rows); NULL for NULL.

    The unit quaternion whose rotation has the largest scalar product with the matrix: the eigenvector of the largest
    eigenvalue of a quadratic form. It is the nearest rotation, too, when the matrix is not quite orthogonal.
    """
    workers_import(df.sparkSession)
    forms = rotation_forms()

    def run(batches):
        for batch in batches:
            given = batch.column(matrix)
            m = given.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
            q = np.linalg.eigh(np.einsum("nij,ijab->nab", m, forms))[1][:, :, 3]
            q = np.where(q[:, :1] < 0, -q, q)
            known = given.is_valid().to_numpy(zero_copy_only=False)
            ends = np.r_[0, np.cumsum(4 * known)].astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(q.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), made], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))
