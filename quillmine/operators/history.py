"""Search history and dashboard statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as T

#: Fixed value: searches that are kept for each owner.
KEPT = 20


def latest(history: DataFrame, n: int = KEPT) -> DataFrame:
    """The n newest rows of each owner. Spark limits each task's rows before the shuffle, so a busy owner sends n a task."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return history.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def deduplicated(history: DataFrame) -> DataFrame:
    """The newest row of each owner and query, by an aggregate that combines before its shuffle."""
    rest = F.struct("created_at", "event_id", "result_count")
    return history.groupBy("user_id", "query").agg(F.max(rest).alias("m")).select("user_id", "query", "m.*")


def saved(history: DataFrame, new: DataFrame, n: int = KEPT) -> DataFrame:
    """The history after new searches are saved: one row a query, the n newest of each owner."""
    return latest(deduplicated(history.unionByName(new)), n).drop("place")


def without(history: DataFrame, user_id: int | None = None, event_id: int | None = None) -> DataFrame:
    """The history without an owner's rows, or without one of them."""
    gone = F.lit(True)
    if user_id is not None:
        gone &= F.col("user_id") == user_id
    if event_id is not None:
        gone &= F.col("event_id") == event_id
    return history.where(~F.coalesce(gone, F.lit(False)))


def search_stats(history: DataFrame, now: datetime) -> DataFrame:
    """For each owner: searches, searches since midnight, mean number of results (rounded half up)."""
    midnight = F.date_trunc("day", T.instant(now))
    return history.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_searches"), F.count_if(F.col("created_at") >= midnight).alias("searches_today"), F.floor(F.coalesce(F.avg("result_count"), F.lit(0.0)) + 0.5).cast("long").alias("average_results"))


def document_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each owner: documents, indexed and failed ones, chunks."""
    n = chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    by = documents.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("index_status") == "failed").alias("failed"))
    return by.join(n, "user_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
