"""Session settings, and tables written to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution and the time zone the queries count on; partition counts are left to the cluster.
CONF = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
#: Bytes of input that a task of an explicit repartitioning is to hold.
TASK_BYTES = 64 << 20


def builder(name: str = "pointloom"):
    out = SparkSession.builder.appName(name)
    for k, v in CONF.items():
        out = out.config(k, v)
    return out


def workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master a temporary folder where that is unset, elsewhere an error.

    A folder of one machine would take each executor's part of a table to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pointloom.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        found = tempfile.mkdtemp(prefix="spark-pointloom-")
        spark.conf.set("pointloom.scratch.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI for pyarrow's file systems: files that tasks open are those that Spark has at the same path."""
    place, store = _place(spark, path)
    return arrow_uri(store.makeQualified(place).toString())


def arrow_uri(uri: str) -> str:
    """Hadoop's name of a place as pyarrow takes it; its connectors for S3 have schemes of their own."""
    scheme, colon, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme == "file" and not rest.startswith("//"):
        rest = f"//{rest}"
    return scheme + colon + rest


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; Hadoop removes it when the application ends, ``clear`` earlier."""
    path = f"{shared_folder(spark)}/pointloom-{what}-{uuid.uuid4().hex}"
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    _made.append(path)
    return path


_made: list[str] = []


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    place, store = _place(spark, path)
    store.delete(place, True)
    if path in _made:
        _made.remove(path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables made so far, for sessions that run many jobs; results must have been written."""
    for path in list(_made):
        discard(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
