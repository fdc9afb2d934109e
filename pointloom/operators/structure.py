"""Wide columns to arrays and back, nesting, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.text import in_suffix_order

SH_REST = 45
#: Columns of a splat file at degree 3, in order.
SPLAT_COLUMNS = [*"xyz", "nx", "ny", "nz", *(f"f_dc_{i}" for i in range(3)), *(f"f_rest_{i}" for i in range(SH_REST)), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]


def to_arrays(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Columns prefix_0, prefix_1, ... as one array each, by number."""
    groups = {p: in_suffix_order(df.columns, p) for p in prefixes}
    used = {c for g in groups.values() for c in g}
    return df.select(*(c for c in df.columns if c not in used), *(F.array(*g).alias(p) for p, g in groups.items()))


def to_columns(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in sizes), *(F.get(p, F.lit(i)).alias(f"{p}_{i}") for p, n in sizes.items() for i in range(n)))


def by_coefficient(rest: str = "f_rest", channels: int = 3) -> F.Column:
    """Channel-major flat coefficients as an array of one array per coefficient."""
    n = (F.size(rest) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*(F.get(rest, i + n * c) for c in range(channels))))


def nest(rows: DataFrame, by: list[str], order: str, item: list[str], out: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, *item))), lambda s: F.struct(*(s[c].alias(c) for c in item))).alias(out))


def unnest(rows: DataFrame, column: str, order: str) -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != column), F.posexplode(column).alias(order, "_item")).select("*", "_item.*").drop("_item")


def mean_size(rows: DataFrame, column: str) -> DataFrame:
    """One row: the mean length of an array column, 0 without rows."""
    return rows.agg(F.coalesce(F.avg(F.size(column)), F.lit(0.0)).alias("mean_size"))


