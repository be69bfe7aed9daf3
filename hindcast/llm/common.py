"""Shared helpers of the corpus operators: staged tables and Arrow text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: A task works on slices of about this many bytes of text, whatever the batch size.
CHUNK_BYTES = 1 << 20

_local_dir: str | None = None
#: Folders of ``stage_buckets`` and their names in the catalog.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session of one machine uses a temporary folder; on a cluster, where
    executors can't see each other's folders, this raises.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.partition("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    if _local_dir is None:
        _local_dir = f"file://{tempfile.mkdtemp(prefix='hindcast-')}"
    return _local_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet to the shared folder, in folders ``by`` some columns, and read it back.

    This cuts the lineage and survives the loss of executors; the reread table has known
    statistics, so joins against it are planned by its real size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def moved(df: DataFrame) -> DataFrame:
    """df as one side of a join for which both sides are shuffled and neither goes through the driver.

    The planner takes a staged table for as large as its file, and a list for one element. Rows that
    repeat their values or have long lists, exploded ones above all, are many times larger in memory,
    so a table that seems small enough to be broadcast may fill the driver.
    """
    return df.hint("merge")


def stage_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stage``, in hash buckets by a column: joins on it don't move the rows again.

    Buckets need a table in the session's catalog; ``unstage`` drops it with its files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    _tables[path.rpartition("/")[2]] = table
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        while "=" in folder.getName():  # a table in folders by columns
            folder = folder.getParent()
        if folder.getName() in _tables:
            spark.sql(f"DROP TABLE {_tables.pop(folder.getName())}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of plans that have run go: they do when the JVM collects them, so that is asked for."""
    spark._jvm.System.gc()
    trim(spark)
    release()


def trim(spark: SparkSession) -> str:
    """Let the driver's JVM give freed native memory back, as ``release`` does for Python; what it says of it.

    Planning and compiling many plans leaves a lot of that. JVMs without this command (jcmd
    System.trim_native_heap) say nothing.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
    try:
        return next(m for m in methods if m.getName() == "invoke").invoke(server, args)
    except Py4JJavaError:
        return ""


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system: Python workers are kept from task to task, and the driver throughout."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most about ``most`` bytes of text (one row at least).

    What the slices of a batch took and left is released after it.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_buffers(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        del batch, _, at
        release()
