"""Incremental indexing: new files of a history folder become index rows, batch by batch, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import wide_rows
from ..schemas import HISTORY


def index_stream(spark: SparkSession, history: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that indexes what is in the folder now and stops; run again for what came since."""
    stream = spark.readStream.schema(HISTORY).parquet(history)

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("pid", F.xxhash64("resource_type", "fhir_id"))
        # a batch that is run again after a failure overwrites its own folder
        wide_rows(rows).write.mode("overwrite").parquet(f"{out}/{n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
