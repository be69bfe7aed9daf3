"""Intermediate tables, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="panel-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written as Parquet and read back: lineage ends here, and a lost executor repeats only what follows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this process has staged; call it when no query that reads them is left."""
    while _written:
        system, at = _system(spark, _written.pop())
        system.delete(at, True)


@atexit.register
def _leave() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        release(spark)


def print_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Size and time of the files under each path: equal as long as nobody has written there."""
    out = []
    for path in paths:
        system, at = _system(spark, path)
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(at)]
    return tuple(sorted(out))
