"""Tables in the folder that all executors share: they cut a plan's growth and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, on one machine only, a local one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def materialised(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return
