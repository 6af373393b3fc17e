"""From extracted texts to indexed chunks with vectors, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.operators import chunking, tables, transcripts
from quillmine.sources.adapters import Embedder, embedded


def chunks_of(documents: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Chunks of documents (document_id, title, extracted_text, video_id); those whose video has segments are packed by time."""
    if segments is None:
        return chunking.chunked(documents.withColumnRenamed("extracted_text", "text"))
    videos = documents.join(segments.select("video_id").distinct(), "video_id", "left_semi")
    texts = documents.join(videos.select("document_id"), "document_id", "left_anti")
    packed = transcripts.packed(segments).drop("topic", "section_path", "end_s").join(videos.select("video_id", "document_id", F.col("title").alias("topic")), "video_id")
    packed = packed.withColumn("section_path", F.array("topic", "subtopic")).withColumn("parent_chunk_index", F.lit(None).cast("int"))
    return chunking.chunked(texts.withColumnRenamed("extracted_text", "text")).unionByName(packed, allowMissingColumns=True)


def indexed(documents: DataFrame, embedder: Embedder, segments: DataFrame | None = None) -> DataFrame:
    """Chunks with ids, enrichment, ``vector`` and ``error``."""
    return embedded(chunking.with_parents(chunking.enriched(chunks_of(documents, segments))), embedder)


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """What a vector store keeps of a chunk beside its vector: owner, place and filters, nothing of its text."""
    return chunks.select("chunk_id", "user_id", "document_id", "chunk_index", "topic", F.coalesce("subtopic", F.lit("")).alias("subtopic"), "title", F.col("type").alias("source_type"), F.coalesce(F.transform("tags", F.lower), F.array().cast("array<string>")).alias("tags"))


def reindexed(store: DataFrame, documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunk store with these documents' rows replaced by the good new ones, and the documents with their state."""
    good = new.where("error is null").drop("error")
    return tables.replaced(store, good), tables.with_index_state(documents, new.select("document_id", "error"))
