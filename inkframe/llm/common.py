"""Shared helpers: scratch tables in the shared folder, row keys, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Arrays of so many bytes are mapped each on its own; the names are glibc's.
MAPPED_BYTES = 1 << 20
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3

_OWN_ROOT: list[str] = []
_MADE: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. One of our
    own where that is unset and the master is local; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="inkframe-"))
        atexit.register(shutil.rmtree, _OWN_ROOT[0], ignore_errors=True)
    return "file://" + _OWN_ROOT[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/inkframe/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, runs the plan
    once, and gives later joins plain exchanges that can be split when skewed.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._inkframe_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` once nothing reads them."""
    for df in tables:
        _delete(df.sparkSession, df._inkframe_path)


def made() -> list[str]:
    """The scratch tables that have not been deleted."""
    return list(_MADE)


def sweep(spark: SparkSession, keep: list[str]) -> None:
    """Delete the scratch tables made since ``keep = made()``: what an operator's
    lazy result reads, once that result has been written."""
    for path in made():
        if path not in keep:
            _delete(spark, path)


def fresh(name: str, columns: list[str]) -> str:
    """``name`` with as many signs in front as no column's name starts with it,
    so it and names made by adding to it clash with none."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def row_key(*cols: Column) -> Column:
    """128-bit key of a row's content; equal rows share it, nulls count."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def batches_of(batches: Iterator, rows: int = 512, keep: str | None = None) -> Iterator:
    """Record batches or arrays in slices of some rows, since single texts may
    be long: Python objects are made of a slice at a time. Spark bounds a whole
    batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``). What a task
    has freed is given back before the next one starts, and of the worker's cache
    no more than ``keep`` stays: other operators' tables go when a task begins."""
    forget(keep)
    release()
    for batch in batches:
        for k in range(0, len(batch) or 1, rows):
            yield batch.slice(k, rows)
    batch = None
    release()


def release() -> None:
    """Give what Arrow and the C library have freed back to the system: a worker
    process lives on from task to task, and its executor's memory holds it. From
    now on large arrays go back as they are freed: glibc would raise its limit to
    the largest of them and keep those below."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc's
        libc.mallopt(M_MMAP_THRESHOLD, MAPPED_BYTES)
        libc.mallopt(M_TRIM_THRESHOLD, 4 * MAPPED_BYTES)
        libc.malloc_trim(0)


def single_thread() -> None:
    """Native libraries in Python workers use the one core their task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def worker_cache() -> dict:
    """What a Python worker keeps from task to task. This package's code travels
    by value, so its globals are made anew for every task; a module of the
    worker's own is not."""
    return sys.modules.setdefault("_inkframe_worker", types.ModuleType("_inkframe_worker")).__dict__


def forget(keep: str | None = None) -> None:
    """Drop what ``worker_cache`` holds under other names than ``keep``."""
    cache = worker_cache()
    for name in [k for k in cache if k != keep and not k.startswith("__")]:
        del cache[name]
