"""Cutting lineage between rounds of an iteration, and the tables that are written on the way."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  A local session that names none gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.applicationId not in _own:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loamline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[sc.applicationId] = "file://" + folder
    return _own[sc.applicationId]


def table_dir(spark: SparkSession, name: str) -> str:
    """A new path for tables of a run.  Results may still read them, so they go when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        # The session, or the JVM with it, may be gone by now: then the folder's owner clears it.
        with contextlib.suppress(Exception):
            delete(spark, path)


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what runs within are dropped when it is done, not when the driver's collector finds them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once and read again: what follows knows their size, and a lost executor costs one step."""
    spark, path = df.sparkSession, table_dir(df.sparkSession, "rounds")
    with dropped_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
