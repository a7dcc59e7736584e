"""The latest-version upsert as a streaming sink: each micro-batch is merged into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.versions import synchronize


def upsert(stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", ts_col: str = "ts") -> StreamingQuery:
    """Keep the newest rows of each id under path/version=<n>; a repeated batch rewrites its own version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}").unionByName(batch)
        synchronize(rows, id_col, ts_col, removed="false").dropDuplicates().write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
