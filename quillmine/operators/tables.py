"""Changes of Parquet tables as rewrites: replace, merge, delete and cascade, each a new DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replaced(table: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the new keys give way to the new rows, as when a document is indexed again."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merged(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: new rows update the columns they have, keep the others, and are inserted where the key is new."""
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys]).withColumn("is_new", F.lit(True))
    both = table.join(n, list(keys), "full_outer")
    value = lambda c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in new.columns else F.col(c)
    return both.select(*keys, *[value(c).alias(c) for c in table.columns if c not in keys])


def inserted(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is not there yet are added; the others stay as they are."""
    return table.unionByName(new.join(table.select(*keys), list(keys), "left_anti"))


def deleted(table: DataFrame, ids: Sequence, key: str = "chunk_id", owner: str | None = None) -> DataFrame:
    """Without these ids (of this owner); ids that are absent are no error."""
    gone = F.col(key).isin(*ids) if ids else F.lit(False)
    if owner is not None:
        gone &= F.col("user_id") == owner
    return table.where(~F.coalesce(gone, F.lit(False)))


def without_document(tables: dict[str, DataFrame], document_id, owner: str) -> dict[str, DataFrame]:
    """All tables without a document of an owner and what belongs to it."""
    return {k: t.where(~F.coalesce((F.col("document_id") == document_id) & (F.col("user_id") == owner), F.lit(False))) for k, t in tables.items()}


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def with_index_state(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with the outcome of indexing: ``results`` has (document_id, error) for each chunk, error null if it worked; other documents stay as they are."""
    by = results.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("why"))
    state = F.when(F.col("n").isNull(), F.col("index_status")).when(F.col("bad") == F.col("n"), "failed").otherwise("indexed")
    joined = documents.join(by, "document_id", "left")
    before = lambda c, default: F.col(c) if c in documents.columns else F.lit(default)
    count = F.when(F.col("n").isNull(), before("chunk_count", 0)).otherwise(F.col("n") - F.col("bad"))
    error = F.when(F.col("n").isNull(), before("index_error", None)).otherwise(F.nullif("why", F.lit("")))
    return joined.withColumns({"index_status": state, "chunk_count": count, "index_error": error}).drop("n", "bad", "why")
