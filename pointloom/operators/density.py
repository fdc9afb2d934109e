"""Adaptive density control of a table of splats.

Rows have gid, position x y z, log scales s0 s1 s2, quaternion q0..q3 (w first), opacity before activation, and any
other columns, which copies take over. New rows are numbered one by one in the order of their parents, from ``next_gid`` on
or after the largest id there is, so ids stay unique and grow by the number of new rows only. Columns named as optimizer
``state`` start from 0 in new rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.harmonics import from_rgb
from pointloom.functions.maths import clamp, d, logit, rotation, safe_ratio, sigmoid
from pointloom.operators.neighbours import mean_distance2
from pointloom.operators.views import global_index

SCALES = ["s0", "s1", "s2"]


def largest_scale() -> Column:
    return F.greatest(*(F.exp(c) for c in SCALES))


def accumulate(visible: DataFrame) -> DataFrame:
    """Per splat: gradient norms summed, times seen, largest radius. visible: gid, gx, gy, radius."""
    seen = visible.filter("radius > 0")
    return seen.groupBy("gid").agg(F.sum(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).alias("grad_accum"), F.count("*").alias("denom"), F.max("radius").alias("max_radius"))


def with_gradient(splats: DataFrame, stats: DataFrame) -> DataFrame:
    """splats with grad (mean norm, 0 when unseen) and max_radius."""
    joined = splats.join(stats, "gid", "left")
    zero = d(0.0)
    grad = safe_ratio(F.coalesce("grad_accum", zero).cast("double"), F.coalesce("denom", F.lit(0)).cast("double"))
    return joined.withColumn("grad", grad).withColumn("max_radius", F.coalesce(F.col("max_radius").cast("double"), zero)).drop("grad_accum", "denom")


def _fresh(rows: DataFrame, slot: Column, state: Iterable[str] = ()) -> DataFrame:
    """Copies without a gradient or state; slot tells those of one parent apart."""
    return rows.withColumn("_slot", slot).withColumns({c: d(0.0) for c in ("grad", "max_radius", *state)})


def numbered(fresh: DataFrame, next_gid: int | DataFrame) -> DataFrame:
    """New rows with ids of their own instead of their parents', from next_gid on, or after the largest id of a table.

    The order is that of parents, so ids do not depend on the partitioning.
    """
    rows = global_index(fresh, ["gid", "_slot"], "_n").drop("_slot")
    if isinstance(next_gid, DataFrame):
        start = next_gid.agg((F.coalesce(F.max("gid"), F.lit(-1)) + 1).alias("_first"))  # one row
        rows = rows.crossJoin(F.broadcast(start))
    else:
        rows = rows.withColumn("_first", F.lit(next_gid))
    return rows.withColumn("gid", (F.col("_first") + F.col("_n")).cast("long")).drop("_first", "_n")


def clones(rows: DataFrame, threshold: float, extent: float, dense: float = 0.01, state: Iterable[str] = ()) -> DataFrame:
    """Copies of small splats with a large gradient, to be numbered."""
    return _fresh(rows.filter((F.col("grad") >= threshold) & (largest_scale() <= dense * extent)), F.lit(0), state)


def children(rows: DataFrame, noise: DataFrame | None, threshold: float, extent: float, dense: float = 0.01, seed: int = 0, state: Iterable[str] = ()) -> DataFrame:
    """Two children of each large splat with a large gradient, at mean + R (noise * scale), 1.6 times smaller, to be numbered.

    noise: gid, child, n0, n1, n2; without it normal noise is drawn from the seed, row by row.
    """
    big = rows.filter((F.col("grad") >= threshold) & (largest_scale() > dense * extent))
    two = big.withColumn("child", F.explode(F.array(F.lit(0), F.lit(1))))
    if noise is None:
        def normal(k: int) -> Column:  # Box-Muller on hashes: the same on every recomputation
            u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * k + j), "gid", "child"), F.lit(1 << 52)) + 0.5) / (1 << 52) for j in (0, 1)]
            return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])

        two = two.withColumns({f"n{k}": normal(k) for k in range(3)})
    else:
        two = two.join(noise, ["gid", "child"])
    r = rotation(*(F.col(f"q{k}") for k in range(4)))
    step = [F.col(f"n{k}") * F.exp(SCALES[k]) for k in range(3)]
    moved = {c: F.col(c) + r[i][0] * step[0] + r[i][1] * step[1] + r[i][2] * step[2] for i, c in enumerate("xyz")}
    two = two.withColumns(moved).withColumns({c: F.ln(F.exp(c) / 1.6) for c in SCALES})
    return _fresh(two, F.col("child") + 1, state).drop("child", "n0", "n1", "n2")


def prune(rows: DataFrame, least_opacity: float, extent: float, size_limit: float | None) -> DataFrame:
    """Rows that are neither transparent nor, when a size limit is set, too large on screen or in the scene."""
    gone = sigmoid(F.col("opacity")) < least_opacity
    if size_limit is not None:
        gone = gone | (F.col("max_radius") > size_limit) | (largest_scale() > 0.1 * extent)
    return rows.filter(~gone)


def control(splats: DataFrame, stats: DataFrame, noise: DataFrame | None, threshold: float = 0.0002, least_opacity: float = 0.005, extent: float = 1.0, size_limit: float | None = None, dense: float = 0.01, next_gid: int | None = None, compat: bool = True, state: Iterable[str] = (), seed: int = 0) -> DataFrame:
    """One control step: clone, split, prune. Copies have no gradient, so a clone is not split in the same step.

    compat: cloning and splitting reset the largest radii before the size test, which then never fires. seed: of the noise,
    if none is given; another one for each step. Write the result before the next step, which reads it several times.
    """
    rows = with_gradient(splats, stats)
    split = (F.col("grad") >= threshold) & (largest_scale() > dense * extent)
    fresh = clones(rows, threshold, extent, dense, state).unionByName(children(rows, noise, threshold, extent, dense, seed, state))
    kept = rows.filter(~split).unionByName(numbered(fresh, splats if next_gid is None else next_gid))
    if compat:
        kept = kept.withColumn("max_radius", d(0.0))
    return prune(kept, least_opacity, extent, size_limit).drop("grad", "max_radius")


def reset_opacity(opacity: Column, cap: float = 0.01) -> Column:
    """Opacity before activation after capping the activated one."""
    return logit(F.least(sigmoid(opacity), d(cap)))


def with_reset_opacity(rows: DataFrame, state: Iterable[str] = (), cap: float = 0.01) -> DataFrame:
    """rows with capped opacity and the optimizer state of opacity back at 0."""
    return rows.withColumns({"opacity": reset_opacity(F.col("opacity"), cap), **{c: d(0.0) for c in state}})


def initial(cloud: DataFrame, opacity: float = 0.1, rest: int = 45) -> DataFrame:
    """Splats of a point cloud (gid, x y z, red green blue in 0..1): round, as large as their neighbours are near.

    Log scales are the logarithm of the root mean squared distance to the three nearest others; the colour is the harmonic
    of degree 0, all others are 0; the rotation is the identity.
    """
    size = mean_distance2(cloud.select("gid", "x", "y", "z")).select("gid", F.ln(F.sqrt(clamp(F.col("dist2"), low=1e-7))).alias("_size"))
    rows = cloud.join(size, "gid")
    return rows.select(
        "gid", "x", "y", "z", F.array(*(from_rgb(F.col(c)) for c in ("red", "green", "blue"))).alias("f_dc"), F.array_repeat(d(0.0), rest).alias("f_rest"),
        logit(d(opacity)).alias("opacity"), *(F.col("_size").alias(c) for c in SCALES), *(d(float(k == 0)).alias(f"q{k}") for k in range(4)),
    )
