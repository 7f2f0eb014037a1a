"""Session settings that the operators' results depend on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Fixed settings: UTC for timestamps, adaptive execution for skew and partition sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "lectern", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` overrides, with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; on one machine, a folder made once if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(context, "_lectern_shared"):
        context._lectern_shared = tempfile.mkdtemp(prefix="lectern-shared-")
    return context._lectern_shared


def stored_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, remembered until ``forget_stored``."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._lectern_paths = [*getattr(context, "_lectern_paths", []), path]
    return path


def stored_copy(df, label: str):
    """``df`` written to the shared folder and read back, so that neither lineage nor work is repeated."""
    path = stored_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, key: str):
    """``df``, dealt out by ``key`` if what is read makes fewer tasks than there are cores."""
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def forget_stored(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder so far; results that aren't written yet need it no more then."""
    context = spark.sparkContext
    for path in getattr(context, "_lectern_paths", []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    context._lectern_paths = []
