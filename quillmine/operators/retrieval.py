"""Ranked retrieval: vector and keyword legs, fusion, reranking and grouping by document."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as T

#: Floors of scores, hits of an answer, and the constants of fusion.
SEARCH_FLOOR, ANSWER_FLOOR, ANSWER_HITS = 0.08, 0.15, 8
RRF_K, VECTOR_SHARE, KEYWORD_SHARE = 60, 0.6, 0.4
#: Weights of a chunk's parts in its final score, and of the fields of a keyword match.
WEIGHTS = {"rrf": 0.45, "vector": 0.20, "keyword": 0.15, "topic": 0.10, "title": 0.05, "phrase": 0.05}
FIELD_WEIGHTS = {"title": 10, "topic": 8, "subtopic": 6, "keywords": 5, "tags": 4, "summary": 3, "text": 1}
#: What MANY chunks, and recency, add to a document.
BONUS, MANY = 0.02, 5


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a literal vector, in double precision; null for zero vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    own = sum(float(x) * float(x) for x in query) ** 0.5
    return dot / F.nullif(norm * F.lit(own), F.lit(0.0))


def vector_hits(vectors: DataFrame, query: Sequence[float], k: int, floor: float = 0.0) -> DataFrame:
    """The k nearest rows with a score from the floor up. The floor is applied before the limit, as both follow the score."""
    return vectors.withColumn("score", cosine(F.col("vector"), query)).where(F.col("score") >= floor).orderBy(F.desc("score"), "chunk_id").limit(k)


def restricted(rows: DataFrame, user_id: str | None = None, documents: DataFrame | None = None, topic: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Rows of an owner, of documents (semi-join), of a topic and with any of the tags; what is not given restricts nothing."""
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if topic:
        rows = rows.where(F.col("topic") == topic)
    if tags:
        rows = rows.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    return rows if documents is None else rows.join(documents.select("document_id"), "document_id", "left_semi")


def keyword_score(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """The sum over fields of weight times the number of different terms among the field's tokens.

    The text score of a document store is not public; this plays its part, and only the order of the leg is used.
    """
    out = F.lit(0)
    for name, weight in FIELD_WEIGHTS.items():
        if name in columns:
            field = F.concat_ws(" ", F.col(name))
            for t in dict.fromkeys(t for t in terms if "-" not in t):
                out = out + F.when(T.has_token(field, t), weight).otherwise(0)
    return out.cast("double")


def keyword_hits(chunks: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """The k best rows by keyword_score, none without a match."""
    return chunks.withColumn("score", keyword_score(chunks.columns, terms)).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)


def fallback_hits(chunks: DataFrame, terms: Sequence[str], k: int) -> DataFrame:
    """The k best rows by the share of terms in any field. Terms are taken literally, and no hits are dropped before ranking."""
    fields = [c for c in FIELD_WEIGHTS if c in chunks.columns]
    return chunks.withColumn("score", T.share_contained(F.concat_ws(" ", *fields), terms)).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)


def ranked(hits: DataFrame, at: str = "rank") -> DataFrame:
    """Hits of a limited leg with their place from 1."""
    return hits.withColumn(at, F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def fused(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two legs (chunk_id, score, rank): a full outer join, absent scores are 0."""
    v = vector.select("chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    k = keyword.select("chunk_id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    part = lambda rank, share: F.coalesce(F.lit(share) / (RRF_K + F.col(rank)), F.lit(0.0))
    both = v.join(k, "chunk_id", "full_outer")
    return both.select(
        "chunk_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), "vector_rank", "keyword_rank",
        (part("vector_rank", VECTOR_SHARE) + part("keyword_rank", KEYWORD_SHARE)).alias("rrf_score"),
    )


def reranked(hits: DataFrame, terms: Sequence[str], phrases: Sequence[str]) -> DataFrame:
    """Hits with chunk columns, and the parts and sum of their final score. The keyword part is counted anew from the text."""
    all_of = lambda *names: F.concat_ws(" ", *[F.col(n) for n in names if n in hits.columns])
    parts = {
        "rrf": F.col("rrf_score"), "vector": F.col("vector_score"), "keyword": T.share_contained(F.col("text"), terms),
        "topic": T.share_contained(all_of("topic", "subtopic", "section_path", "tags", "keywords"), terms), "title": T.share_contained(F.col("title"), terms),
        "phrase": T.share_contained(all_of("text", "title", "topic", "subtopic", "summary"), phrases),
    }
    scored = hits.withColumns({f"{k}_part": c for k, c in parts.items()})
    return scored.withColumn("final_score", sum((F.lit(w) * F.col(f"{k}_part") for k, w in WEIGHTS.items()), F.lit(0.0)))


def grouped(hits: DataFrame, documents: DataFrame, now: datetime) -> DataFrame:
    """One row a document that is known: its best chunk, all its chunks in order, and its score.

    A document scores its best chunk's final score, up to 0.02 for five chunks, and 0.02 times its recency.
    """
    order = F.struct((-F.col("final_score")).alias("o1"), (-F.col("rrf_score")).alias("o2"), F.coalesce("vector_rank", F.lit(1 << 30)).alias("o3"), F.coalesce("keyword_rank", F.lit(1 << 30)).alias("o4"), F.col("chunk_id").alias("o5"))
    known = hits.join(documents.select("document_id", F.col("user_id"), F.col("title").alias("document_title"), F.col("type").alias("document_type"), "created_at"), ["document_id", "user_id"])
    more = [c for c in ("title", "subtopic", "section_path", "video_id", "start_s") if c in known.columns]
    by = known.groupBy("document_id", "document_title", "document_type", "created_at").agg(
        F.max("final_score").alias("best_score"), F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "chunk_id", "chunk_index", "final_score", "content_preview", "topic", *more))).alias("matched")
    )
    bonus = BONUS * F.least(F.col("n_chunks"), F.lit(MANY)) / MANY + BONUS * T.recency(F.col("created_at"), T.instant(now))
    return by.withColumn("score", F.col("best_score") + bonus).withColumn("top", F.col("matched")[0])


def vector_only(hits: DataFrame) -> DataFrame:
    """Hits of the vector leg alone in the form of fused ones: no keyword score, the vector score for the fused."""
    return ranked(hits).select("chunk_id", F.col("score").alias("vector_score"), F.lit(0.0).alias("keyword_score"), F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"), F.col("score").alias("rrf_score"))


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """The same rows; running it fails if a vector has another dimension."""
    wrong = F.assert_true(F.size("vector") == dimension, F.concat(F.lit(f"expected dimension {dimension}, got "), F.size("vector").cast("string")))
    return vectors.where(wrong.isNull())


def rows_of(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk are dropped. Hits are few, so it is they that are broadcast."""
    return chunks.join(F.broadcast(ids), "chunk_id")
