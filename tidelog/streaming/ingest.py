"""Structured Streaming into a store: each micro-batch is one commit, and a repeated batch is skipped.

An extension: arrival order decides, so late rows win as any later write does and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.store import Store


def changelog_stream(spark: SparkSession, path: str, schema: str = "key binary, value binary, op tinyint, seq long", files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet change files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, ordered_by: str = "seq", available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes to `store`. A batch and its number are one commit, so a restart applies none twice.

    The stream is known by its checkpoint folder, which numbers the batches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(batch, ordered_by, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def running_latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate (output mode update or complete)."""
    payload = F.struct(F.col("value"), F.col("op"), F.col("seq"))
    return stream.groupBy("key").agg(F.max_by(payload, "seq").alias("m")).select("key", "m.value", "m.op", "m.seq")
