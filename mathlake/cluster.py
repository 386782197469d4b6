"""What jobs need on a cluster: this package on the executors, batches of bounded size, and a shared folder for stages."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that go to a Python worker at once, so that long texts do not add up to a batch that no worker can hold.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of any cluster, and bounds the batches they are sent."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.mathlake.batches", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.mathlake.batches", "set")
    if getattr(sc, "_mathlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="mathlake-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(to := os.path.join(folder, "mathlake_code.zip"), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._mathlake_shipped = True


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and what a task left behind would count against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """A task's function that gives its memory back at its end."""

    def inner(parts: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(parts)
        finally:
            give_back()

    return inner


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session names it, but for local sessions, which get a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="mathlake-shared-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def place(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, as the session's JVM knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder, in folders by `by`, and reads it back.

    Survives the loss of executors, and what is written is computed once however often it is read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    at, fs = place(spark, path)
    fs.deleteOnExit(at)  # what nobody discards goes with the session
    return out


def growing(df: DataFrame) -> DataFrame:
    """A side of a join with rows for each formula or document: sorted, never broadcast.

    Its file is compressed many times over, so by its size it looks small enough to be sent whole to every executor.
    """
    return df.hint("merge")


def discard(*frames: DataFrame) -> None:
    """Deletes tables of materialise() that nothing lazy reads any more."""
    for df in frames:
        at, fs = place(df.sparkSession, df.written_to)
        fs.delete(at, True)
