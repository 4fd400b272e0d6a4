"""The folder that driver and executors share, and the tables that are written to it and removed again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """The session names no folder that the executors can reach."""


_own: list[str] = []
#: Paths written in the open scope; outside of any, those to remove when the process ends.
_scope: ContextVar[list | None] = ContextVar("tables", default=None)
_left: list = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where it is unset and all work is done on this machine, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolder("spark.checkpoint.dir is not set: executors on other machines need a folder that they share with the driver")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tallyloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the open scope is left, else when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = _scope.get()
    (_left if where is None else where).append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read back: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := shared_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that operators write inside are removed on leaving; results must have been written or read by then."""
    token = _scope.set([])
    try:
        yield
    finally:
        _remove(_scope.get())
        _scope.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path of ``shared_path`` before its scope ends."""
    _remove([(spark._jvm, spark._jsc.hadoopConfiguration(), path)])


def _remove(paths: list) -> None:
    for jvm, conf, path in paths:
        with suppress(Exception):  # the JVM may be gone
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    paths.clear()


atexit.register(_remove, _left)
