"""Tables that are written once and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


_paths: set[str] = set()
_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names, which all executors share.

    Where it is unset, a temporary one in local mode (tests); on a cluster that is an error, as executors would each
    write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="canopy-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new folder's name there."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet: later reads are the same rows and survive lost executors.

    The table stays until discard() names it or clear() ends all of them; at the latest, when the program ends.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if not _paths:
        atexit.register(at_end, df.sparkSession)
    _paths.add(path)
    _of[found] = path
    return found


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of frames that stored() returned, once nothing that is still to run reads them."""
    for df in frames:
        if path := _of.pop(df, None):
            _paths.discard(path)
            remove(df.sparkSession, path)


def at_end(spark: SparkSession) -> None:
    """clear(), where the JVM is still there."""
    with contextlib.suppress(Exception):
        clear(spark)


def clear(spark: SparkSession) -> None:
    """Deletes all that stored() has written and that is still there: for when no result is to be read any more."""
    if spark.sparkContext._jsc is None:  # stopped
        return
    while _paths:
        remove(spark, _paths.pop())
