"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the scratch blocks that are open.
_open: list[str] = []
#: Folders that go when the session's file system is closed.
_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or, where it is unset (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _run_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path, fs = _path(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there,
    so losing an executor never recomputes what came before."""
    return _written(df, _open[-1] if _open else _run_dir(df.sparkSession))


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is cut in this block is deleted at its end; the function it gives writes a result
    that stays."""
    outer = _open[-1] if _open else _run_dir(spark)
    folder = f"{outer}/scratch-{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _open.pop()
        path, fs = _path(spark, folder)
        fs.delete(path, True)


def delete(spark: SparkSession, folder: str, keep: set[str], before: int | None = None) -> int:
    """Delete what lies in a folder, but for the names to keep and, with before, those that as
    numbers are not below it; the number of what went."""
    path, fs = _path(spark, folder)
    gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in keep] if fs.exists(path) else []
    gone = [p for p in gone if before is None or int(p.getName()) < before]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def session_dir(spark: SparkSession, name: str) -> str:
    """A new folder that goes with the application."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
