"""Helpers shared by the text operators: the shared scratch folder, column checks and per-worker memos."""

from __future__ import annotations

import contextlib
import contextvars
import sys
import types
import uuid
import weakref
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_root

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("canopy_scope", default=None)
#: Where stored() wrote the frames that it returned.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside the block is deleted at its end; store outside of it what is to stay."""
    path = f"{_scope.get() or shared_root(spark)}/{uuid.uuid4().hex}"
    before = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(before)
        delete(spark, path)


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder: later reads survive lost executors.

    lasting: outside of the scratch() block that this is called in.
    """
    spark = df.sparkSession
    path = f"{(None if lasting else _scope.get()) or shared_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _written[found] = path
    return found


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, once nothing that is still to run reads them."""
    for df in frames:
        if path := _written.pop(df, None):
            delete(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(id_column: str, folds: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def worker_memo(name: str) -> dict:
    """A dictionary that lives as long as this Python worker; tasks of one worker share it."""
    holder = sys.modules.setdefault("_canopy_worker_memo", types.ModuleType("_canopy_worker_memo"))
    return holder.__dict__.setdefault(name, {})


def by_rows(frames: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Cuts large batches, so that what a task makes of one stays small."""
    for frame in frames:
        for start in range(0, len(frame), rows):
            yield frame.iloc[start : start + rows]
