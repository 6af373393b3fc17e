"""The engine's tables as views over a folder of Parquet tables.

The folders at hand have no titles, owners or chunks of their own, so one mapping is fixed here: a row of ``documents``
is a chunk, four of them are a document; ``embeddings`` has a chunk's vector and topic; ``events`` is the search
history; ``conversations`` are transcripts. AS_OF stands for the present.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.functions import text as T

AS_OF = datetime(2024, 1, 31)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One row a chunk: ids, owner, place in its document, text, title, topic, subtopic, tags, preview."""
    d = read(spark, folder, "documents")
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80)
    document = F.floor(F.col("doc_id") / 4)
    return d.select(
        F.col("doc_id").alias("chunk_id"), document.alias("document_id"), (F.col("doc_id") % 4).cast("int").alias("chunk_index"),
        F.concat(F.lit("u"), (document % 2).cast("string")).alias("user_id"), "text", title.alias("title"),
        F.concat(F.lit("topic "), (F.col("doc_id") % 10).cast("string")).alias("topic"), F.col("lang").alias("subtopic"),
        F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.array("lang", "source")).alias("tags"), F.col("lang").alias("type"), T.content_preview(F.col("text")).alias("content_preview"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, after its first chunk: owner, title, type, state of indexing, time of creation."""
    first = chunks(spark, folder).where("chunk_index = 0")
    good = read(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    created = T.instant(AS_OF) - F.make_interval(days=(F.col("document_id") % 120).cast("int"))
    state = F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return first.join(good, "chunk_id", "left").select("document_id", "user_id", "title", "type", created.alias("created_at"), state.alias("index_status"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def vector_of(spark: SparkSession, folder: str, chunk_id: int) -> list[float]:
    """A stored vector, which stands for the embedding of a query."""
    row = vectors(spark, folder).where(F.col("chunk_id") == chunk_id).select("vector").first()
    if row is None:
        raise LookupError(f"no vector {chunk_id}")
    return row["vector"]


def history(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    query = F.concat(F.col("event_type"), F.lit(":"), F.get_json_object("props", "$.k"))
    return e.select("event_id", "user_id", query.alias("query"), F.floor("value").cast("int").alias("result_count"), F.col("ts").cast("timestamp").alias("created_at"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript segments of each conversation; a segment lasts a second for every 15 characters."""
    c = read(spark, folder, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("i"), "text")
    over = Window.partitionBy("video_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    read_to = F.sum(F.length("text")).over(over)
    return c.select("video_id", "i", "text", ((read_to - F.length("text")) / 15).alias("start_s"), (read_to / 15).alias("end_s"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each row of ``documents``, numbered from 0."""
    return read(spark, folder, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
