"""Depth-prior calibration by robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.maths import d
from pointloom.operators.views import global_index
from pointloom.session import written


def medians(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """by and the exact median of each value (column by name) that is not NULL, NULL where a group has none.

    All values are put in order by ranges of (value's name, by, value), numbered as they are written. A row for each group and
    range tells where a group's middle is; the one or two rows there are looked up by number. Nothing holds a group.
    """
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), d(v).alias("v")) for k, v in enumerate(values.values()))))
    flat = rows.select(F.struct(*by).alias("_by"), stacked.alias("_s")).select("_by", "_s.*").filter("v IS NOT NULL")
    order = ["k", "_by", "v"]
    placed = written(flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "values")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("k", "_by", part).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    whole = Window.partitionBy("k", "_by")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).withColumn("all", F.sum("n").over(whole))
    middle = F.explode(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))).alias("m")
    asked = runs.select("low", "n", "before", middle).filter((F.col("m") >= F.col("before")) & (F.col("m") < F.col("before") + F.col("n")))
    found = asked.select((F.col("low") + F.col("m") - F.col("before")).alias("at")).join(placed, "at")
    each = [F.avg(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(values)]
    return found.groupBy("_by").agg(*each).select("_by.*", *values)


def spread(rows: DataFrame, by: list[str], values: dict[str, str], valid: str, model: str) -> DataFrame:
    """By group: exact medians t_NAME of valid values, mean absolute deviations s_NAME about them, n_valid, and _range of model.

    values: column by name. rows are read three times, whatever the number of values: for medians, for counts, and for the
    deviations. A group's medians reach its rows by a join, and all else is partial sums, so no task holds a group.
    """
    ok = F.col(valid)
    middle = medians(rows, by, {f"t_{n}": F.when(ok, F.col(c)) for n, c in values.items()})
    middle = written(middle, "medians")
    first = rows.groupBy(*by).agg(F.count_if(ok).alias("n_valid"), (F.max(model) - F.min(model)).alias("_range"))
    near = middle.select(F.struct(*by).alias("_by"), *(f"t_{n}" for n in values))
    told = rows.select(F.struct(*by).alias("_by"), *(F.when(ok, F.col(c)).alias(f"v_{n}") for n, c in values.items())).join(near, "_by")
    away = told.groupBy("_by").agg(*(F.avg(F.abs(F.col(f"v_{n}") - F.col(f"t_{n}"))).alias(f"s_{n}") for n in values))
    out = first.withColumn("_by", F.struct(*by)).join(near, "_by", "left").join(away, "_by", "left")
    return out.drop("_by")


def calibrate(rows: DataFrame, by: list[str], model: str, prior: str, valid: str, least: int = 10, least_range: float = 1e-3) -> DataFrame:
    """scale and offset that take prior to model, by group; 0, 0 when too few values or too small a range.

    The range is that of all rows; medians, deviations and the count are those of valid ones. Groups without any valid
    row have 0, 0 as well.
    """
    out = spread(rows, by, {"model": model, "prior": prior}, valid, model)
    good = (F.col("n_valid") > least) & (F.col("_range") > least_range) & (F.col("s_prior") > 0)
    scale = F.when(good, F.col("s_model") / F.nullif("s_prior", d(0.0))).otherwise(d(0.0))
    out = out.withColumn("scale", scale)
    return out.select(*by, "n_valid", "scale", F.when(good, F.col("t_model") - F.col("t_prior") * F.col("scale")).otherwise(d(0.0)).alias("offset"))


def overall_median(rows: DataFrame, value: str) -> DataFrame:
    """One row: median, the exact median of all values that are not NULL, by their places in the order; no task has them all."""
    placed = global_index(rows.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")), ["_v"], "_at")
    n = placed.agg(F.count("*").alias("_n"))  # one row
    here = placed.crossJoin(F.broadcast(n)).filter(F.col("_at").isin(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    return here.agg(F.avg("_v").alias("median"))


def gate(params: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """params with med_scale (median of positive scales, 0 without any) and reliable.

    A NULL scale is reliable: nothing is known against it. params are written first, since they are read three times.
    """
    params = written(params, "params")
    middle = overall_median(params.filter("scale > 0"), "scale").select(F.coalesce("median", d(0.0)).alias("med_scale"))
    far = (F.col("scale") < low * F.col("med_scale")) | (F.col("scale") > high * F.col("med_scale"))
    return params.crossJoin(F.broadcast(middle)).withColumn("reliable", ~F.coalesce(far, F.lit(False)))


def calibrated(depth, scale, offset):
    """Inverse depth with its parameters applied where the scale is positive; negative values are 0 first."""
    depth = F.greatest(depth, d(0.0))
    return F.when(F.coalesce(scale, d(0.0)) > 0, depth * scale + offset).otherwise(depth)


def scene_norm(centres: DataFrame, columns: list[str], slack: float = 1.1) -> DataFrame:
    """One row: translate (minus the mean of centres) and radius (largest distance from it times slack)."""
    mean = centres.agg(*(F.avg(c).alias(f"_{c}") for c in columns))  # one row
    far = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in columns[1:]), (F.col(columns[0]) - F.col(f"_{columns[0]}")) ** 2)
    rows = centres.crossJoin(F.broadcast(mean))
    return rows.agg(*(F.first(-F.col(f"_{c}")).alias(f"translate_{c}") for c in columns), (slack * F.max(F.sqrt(far))).alias("radius"))
