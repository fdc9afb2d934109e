"""View requests as they arrive from an interactive viewer, and running statistics over them.

Works on batch and streaming frames alike; the reader side has no streaming of its own, so this is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = (
    "resolution_x int, resolution_y int, train boolean, fov_y double, fov_x double, z_near double, z_far double, shs_python boolean, "
    "rot_scale_python boolean, keep_alive boolean, scaling_modifier double, view_matrix array<double>, view_projection_matrix array<double>"
)


def parse(messages: DataFrame, column: str = "value") -> DataFrame:
    """messages with the fields of their JSON; axes 1 and 2 of the view matrices are flipped. Requests for no pixels are left out."""
    rows = messages.withColumn("_r", F.from_json(F.col(column).cast("string"), REQUEST)).filter("_r.resolution_x <> 0 and _r.resolution_y <> 0")
    flip = lambda c, axes: F.transform(c, lambda v, i: F.when((i % 4).isin(*axes), -v).otherwise(v))
    rows = rows.select(*messages.columns, "_r.*")
    return rows.withColumn("view_matrix", flip("view_matrix", (1, 2))).withColumn("view_projection_matrix", flip("view_projection_matrix", (1,)))


def rates(requests: DataFrame, time: str, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Requests for each window of event time, within a watermark."""
    return requests.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("requests"), F.avg("scaling_modifier").alias("mean_scaling"))
