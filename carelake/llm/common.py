"""Shared helpers: a workspace in the cluster's shared folder, table access and batch slicing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, on one machine only, a local one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Removes a table made by written(), once nothing lazy reads it any more."""
    for f in df.inputFiles()[:1]:
        drop_path(df.sparkSession, f.rsplit("/", 1)[0])


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            return


def row_slices(arr: pa.StringArray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column holding about limit bytes each, one row at least."""
    import numpy as np

    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, len(arr))
        lo = hi


def text_column(batch: pa.RecordBatch, name: str) -> pa.StringArray:
    """The column as plain UTF-8 strings, null as the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


@lru_cache(1)
def _trimmer():
    """The C library's way to give freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release() -> None:
    """Gives memory that a batch has freed back to the system: a worker lives through many stages and would keep the largest."""
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim is not None:
        trim(0)
