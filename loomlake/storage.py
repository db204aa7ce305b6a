"""Folders for intermediate data that the driver and all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose executors run in the driver's own process
    (master ``local[...]``); on a cluster that is an error, as executors couldn't read each other's files.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="loomlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """The file system that a path belongs to, and the path, as Hadoop names them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    files, where = _at(spark, path)
    files.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it isn't there."""
    files, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def make_folder(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.mkdirs(where)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder to another that isn't there yet."""
    files, where = _at(spark, path)
    _, target = _at(spark, to)
    files.mkdirs(target.getParent())
    if not files.rename(where, target):
        raise OSError(f"{path} can't be moved to {to}")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
