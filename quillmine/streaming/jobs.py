"""Ingest and statistics as Structured Streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, folder: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "document_id") -> StreamingQuery:
    """Run a batch transform over new JSON files of a folder. Each batch is a folder of the target that a retry overwrites, so none is added twice."""

    def write(batch: DataFrame, n: int) -> None:
        transform(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_searches(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Searches a day and kind of a stream of events (ts, event_type); a day is final once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("searches")).select(F.col("w.start").alias("day"), "event_type", "searches")


def run_daily_searches(spark: SparkSession, folder: str, schema: StructType | str, target: str, checkpoint: str) -> StreamingQuery:
    stream = spark.readStream.schema(schema).parquet(folder)
    return daily_searches(stream).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_checkpoint(folder: str) -> str:
    return f"{folder}/{uuid.uuid4()}"
