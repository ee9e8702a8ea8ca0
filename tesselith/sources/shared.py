"""The folder that driver and executors share, and scratch paths in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and the master is local, a temporary folder is made and set.

    On a cluster an unset folder is an error: other executors would not see a
    machine-local one.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tesselith-')}"
    context.setCheckpointDir(own)
    atexit.register(_remove_quietly, spark, own)
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tesselith/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path by whatever file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone when Python ends
        pass
