"""The search pipeline: filters, two legs, fusion, reranking, grouping and a page of results, as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import query as Q
from quillmine.functions import text as T
from quillmine.operators import retrieval as R


def allowed_documents(documents: DataFrame, user_id: str, f: Q.Filter, now: datetime) -> DataFrame | None:
    """Indexed documents of the owner that the filter lets through; None where it restricts neither type nor date."""
    start, end = Q.date_range(f, now)
    if not (f.type or start or end):
        return None
    rows = documents.where((F.col("user_id") == user_id) & (F.col("index_status") == "indexed"))
    if f.type:
        rows = rows.where(F.col("type") == f.type)
    if start:
        rows = rows.where(F.col("created_at") >= T.instant(start))
    return rows.where(F.col("created_at") <= T.instant(end)) if end else rows


def search(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, user_id: str, query: str, vector: Sequence[float], now: datetime, page: object = 1, limit: object = 20, f: Q.Filter | None = None) -> DataFrame:
    """A page of documents for a query whose embedding is ``vector``.

    Topic and tag restrict the vector leg alone; the number of hits of each leg grows with the page, and ``total`` counts
    the documents in that window, not in the corpus. Where chunks have them, results also tell the best chunk's
    ``section_path``, and for videos its ``timestamp`` and the ``video_url`` that begins there.
    """
    f, page, limit = f or Q.Filter(), Q.page_of(page), Q.limit_of(limit)
    query = Q.checked_query(query)
    terms, phrases, k = Q.tokens(query), Q.phrases(query), Q.window_of(page, limit)
    ids = allowed_documents(documents, user_id, f, now)
    own = R.restricted(chunks, user_id, ids)
    near = R.restricted(own, topic=f.topic, tags=[f.tag] if f.tag else []).select("chunk_id").join(vectors, "chunk_id")
    v = R.ranked(R.vector_hits(near, vector, k, R.SEARCH_FLOOR).select("chunk_id", "score"))
    w = R.ranked(R.keyword_hits(own, terms, k).select("chunk_id", "score"))
    groups = R.grouped(R.reranked(R.rows_of(R.fused(v, w), own), terms, phrases), documents, now)
    order = [F.desc("score"), F.col("top.o"), F.col("document_id")]
    top, video = F.col("top"), F.col("document_type") == "video"
    more = [top["section_path"].alias("section_path")] if "section_path" in chunks.columns else []
    if {"video_id", "start_s"} <= set(chunks.columns):
        more += [F.when(video, T.clock(top["start_s"])).alias("timestamp"), F.when(video, T.watch_url(top["video_id"], top["start_s"])).alias("video_url")]
    few = groups.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "total": F.count(F.lit(1)).over(Window.partitionBy())})
    return few.where(F.col("place").between((page - 1) * limit + 1, page * limit)).select(
        "place", "document_id", F.col("document_title").alias("title"), F.col("document_type").alias("type"), T.two_decimals(F.col("score")).alias("score"), F.col("n_chunks").cast("int").alias("n_chunks"),
        F.col("top.chunk_id").alias("top_chunk"), F.col("top.topic").alias("topic"), T.preview_snippet(F.col("top.content_preview"), terms).alias("preview"),
        F.array_join(F.transform("matched", lambda m: m["chunk_id"].cast("string")), ",").alias("chunks"), F.col("total").cast("int").alias("total"), *more,
    )
