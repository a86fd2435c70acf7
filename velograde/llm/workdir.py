"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests, a single machine) a local one is used. Tables cut the lineage: a lost
executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Seconds between two collections that a grown heap of the driver asks for.
SETTLE_S = 5.0
_settled = [float("-inf")]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="velograde-"))
        found = _own[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/velograde/{name}-{uuid.uuid4().hex[:12]}"


def open_dir(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, for tasks that write files of their own format."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``codec``: how it is compressed, if not as the session says."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    settle(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._velograde_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`table` that nothing reads any more."""
    remove(df.sparkSession, df._velograde_path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def rows_below(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has fewer than ``limit`` rows: the check before any broadcast hint."""
    return df.limit(limit).count() < limit


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the driver collects their objects."""
    gc.collect()
    spark._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Collect the garbage of plans that are done once the driver's heap has grown to half of its limit, every few seconds at most: left alone it grows to the limit and stays there."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory() and time.monotonic() - _settled[0] > SETTLE_S:
        release(spark)
        _settled[0] = time.monotonic()


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
