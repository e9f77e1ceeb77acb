"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only if its measured size stays below this; else the join shuffles.
BROADCAST_BYTES = 32 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one on a local master where it is unset (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir.setdefault(sc.applicationId, "")
        if not base:
            base = _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="hallspark-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under :func:`shared_dir`, removed when the driver ends."""
    path = f"{shared_dir(spark)}/hallspark-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside, so that whole texts need little memory on the JVM's and on Python's side. No result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if not before or not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        if before:
            spark.conf.set(key, before)
        else:
            spark.conf.unset(key)


def materialize(df: DataFrame, name: str, *, long_rows: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back. ``long_rows``: Python tasks before it get texts, or other long values, in small batches."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark) if long_rows else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(small: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its counted rows times ``row_bytes`` (or the sum of that column) stay below ``limit``; else leave it to a shuffle join."""
    size = small.count() * row_bytes if isinstance(row_bytes, int) else small.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(small) if size <= limit else small


def blanks_as(text: Column, blanks: str, blank: str = " ") -> Column:
    """``text`` with each of ``blanks`` replaced. Faster than translate(), which looks every character up."""
    for one in blanks:
        text = F.replace(text, F.lit(one), F.lit(blank))
    return text


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_kept: dict = {}


def trim() -> None:
    """Give the memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def kept_in_worker(name: tuple, make: Callable):
    """What a Python worker keeps between its tasks, by name. It keeps one thing: a task of another operator drops it."""
    if name not in _kept:
        drop_kept()
        _kept[name] = make()
    return _kept[name]


def drop_kept() -> None:
    if _kept:
        _kept.clear()
        gc.collect()
    trim()


def alone(task: Callable) -> Callable:
    """A task for mapInArrow that keeps nothing in its worker and drops what tasks of other operators kept there."""

    def run(batches):
        drop_kept()
        yield from task(batches)
        trim()

    return run


def key_runs(batches, keys: int):
    """Runs of rows with equal values in the first ``keys`` columns, which are numbers, each as one batch; sorted input."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        whole = table.to_batches()[0]
        for a, b in zip(starts, starts[1:], strict=False):
            yield whole.slice(a, b - a)
        held = whole.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held
