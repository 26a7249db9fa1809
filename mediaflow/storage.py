"""Shared storage for checkpoints and intermediate tables.

The folder comes from the session's ``spark.checkpoint.dir``; where that is unset, it is a folder in the session's
warehouse. Moving and deleting go through the file system of the path, as Spark itself sees it.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder, as a URI; sets the checkpoint directory where none is active."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get(CHECKPOINT_CONF, None)
        if not root:
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        context.setCheckpointDir(root)
    # Spark adds a folder of this application to the root and its file system's scheme.
    root = context.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]
    return root.replace("file:/", "file:///", 1) if re.match("file:/[^/]", root) else root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; what lies there goes when the driver's program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_tidy, spark, path)
    return path


def _tidy(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session is gone, and its folder is the cluster's to clean
        pass


def arrow_path(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path, for tasks that read or write single files."""
    filesystem, path = fs.FileSystem.from_uri(uri)
    return filesystem, path.rstrip("/")


def _location(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, location = _location(spark, path)
    return filesystem.exists(location)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with all it holds; a path that is not there is no fault."""
    filesystem, location = _location(spark, path)
    filesystem.delete(location, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename within one file system; fails where the target exists."""
    filesystem, start = _location(spark, source)
    _, end = _location(spark, target)
    if filesystem.exists(end) or not filesystem.rename(start, end):
        raise OSError(f"cannot move {source} to {target}")
