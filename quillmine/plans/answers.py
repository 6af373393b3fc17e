"""Retrieval-augmented answers and summaries: retrieval and context are one plan each, the model is an adapter."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillmine.functions import text as T
from quillmine.functions.query import RequestError, checked_question
from quillmine.operators import context as C
from quillmine.operators import retrieval as R
from quillmine.sources.adapters import ChatModel, service_error, tried

#: Fixed value: the answer where no source has it.
NO_ANSWER = "I couldn't find that information in your saved documents."
#: Our own wording of the task.
ANSWER_TASK = f"Answer the question from the given sources alone, name the source of each statement, and reply exactly \"{NO_ANSWER}\" if they do not hold the answer."
SUMMARY_TASK = 'Summarise the document. Reply with JSON: {"summary": string, "keyPoints": [string], "topics": [string]}.'


@dataclass
class Answer:
    text: str
    sources: list[Row] = field(default_factory=list)
    seconds: float = 0.0


def retrieved(chunks: DataFrame, vectors: DataFrame, user_id: str, vector: Sequence[float], top_k: int = R.ANSWER_HITS, floor: float = R.ANSWER_FLOOR, documents: DataFrame | None = None) -> DataFrame:
    """The chunks nearest to a question, by the vector leg alone."""
    if not 1 <= top_k <= 50:
        raise RequestError("topK must be between 1 and 50")
    own = R.restricted(chunks, user_id, documents)
    hits = R.vector_hits(own.select("chunk_id").join(vectors.select("chunk_id", "vector"), "chunk_id"), vector, top_k, floor)
    return R.rows_of(hits.select("chunk_id", "score"), own)


def titled(hits: DataFrame, documents: DataFrame) -> DataFrame:
    return hits.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id", "left")


def messages(task: str, context: str, question: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": task}, {"role": "user", "content": f"Sources:\n\n{context}\n\nQuestion: {question}"}]


def answer(hits: DataFrame, question: object, model: ChatModel, budget: int = C.BUDGET) -> Answer:
    """Ask the model with the context of these hits (with document_title). No hit, no call."""
    began, asked = time.monotonic(), checked_question(question)
    row = C.built(hits, budget).first()
    if row is None or not row["n_sources"]:
        return Answer(NO_ANSWER, [], time.monotonic() - began)
    try:
        said = tried(lambda: model.complete(messages(ANSWER_TASK, row["context"], asked)))
    except Exception as e:
        raise service_error(str(e)) from e
    cited = C.citations(C.within_budget(C.deduplicated(hits), budget)).orderBy("place").collect()  # as many as the budget lets in
    return Answer(content_text(said), cited, time.monotonic() - began)


def content_text(said: object) -> str:
    """The text of a model's content, which is a string or a list of parts."""
    if isinstance(said, str):
        return said.strip()
    parts = [p if isinstance(p, str) else p.get("text", "") for p in said] if isinstance(said, list) else []
    return "".join(parts).strip()


def summary_key(documents: DataFrame) -> DataFrame:
    """The key under which a document's summary may be kept: it changes with the document."""
    return documents.select("document_id", F.concat_ws(":", "document_id", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("cache_key"))


def summarize(chunks: DataFrame, document_id, model: ChatModel, spark, budget: int = C.BUDGET) -> Row:
    """(summary, key_points, topics) of a document from its chunks in order, as far as the budget goes."""
    rows = chunks.where(F.col("document_id") == document_id).withColumn("chunk_id", F.col("chunk_index")).withColumn("score", F.lit(1.0)).withColumn("document_title", F.col("title"))
    row = C.built(rows, budget).first()
    if row is None or not row["n_sources"]:
        raise RequestError("Document has no indexed content", 404)
    try:
        said = tried(lambda: model.complete(messages(SUMMARY_TASK, row["context"], "")))
    except Exception as e:
        raise service_error(str(e)) from e
    return spark.createDataFrame([(content_text(said),)], "raw string").select(T.summary_json(F.col("raw")).alias("s")).select("s.*").first()
