"""Intermediate tables: written to the shared folder and read again, which cuts the lineage.

A lost executor then costs a reread, never the recomputation of a long lineage.
The file system removes an intermediate when the driver ends; :func:`forget`
removes one earlier, in loops that make many.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a local session gets a temporary one; on a cluster that is an error, as executors would not share it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="notelake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; this application's paths stand in one folder, removed when the driver ends."""
    own = f"{shared_folder(spark)}/notelake-{spark.sparkContext.applicationId}"
    files, place = _file_system(spark, own)
    if files.mkdirs(place):
        files.deleteOnExit(place)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove what stands at a path of :func:`new_path` before the driver ends."""
    files, place = _file_system(spark, path)
    files.delete(place, True)
