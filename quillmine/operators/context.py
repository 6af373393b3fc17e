"""Token-bounded context for answers: deduplication, budget, formatting and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as T

#: Tokens of a context, what separates its blocks, tokens that a block costs besides its text.
BUDGET, SEPARATOR, HEADER_TOKENS = 4000, "\n\n---\n\n", 8


def deduplicated(hits: DataFrame) -> DataFrame:
    """One hit for each chunk of a document, the best; of equal ones that of the smallest chunk_id. Combines before its shuffle."""
    rest = [c for c in hits.columns if c not in ("document_id", "chunk_index")]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("score"), "chunk_id")).alias("best")
    return hits.groupBy("document_id", "chunk_index").agg(best).select("document_id", "chunk_index", "best.*")


def block_cost(document_title: Column, title: Column, text: Column) -> Column:
    header = F.concat(F.lit("[Source] "), F.coalesce(document_title, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))
    return T.token_count(header) + T.token_count(text) + HEADER_TOKENS


def within_budget(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The best hits, as long as their costs stay within the budget; the first always. Adds ``place``, from 1.

    Costs are positive, so no hit after the first that exceeds the budget could fit again. A hit costs at least
    HEADER_TOKENS, so budget / HEADER_TOKENS of them are sorted at most before the running sum.
    """
    few = hits.orderBy(F.desc("score"), "chunk_id").limit(budget // HEADER_TOKENS + 1)
    order = Window.orderBy(F.desc("score"), "chunk_id")
    few = few.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(block_cost(F.col("document_title"), F.col("title"), F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return few.where((F.col("place") == 1) | (F.col("used") <= budget))


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def is_video(df: DataFrame) -> Column:
    return F.coalesce(_column(df, "type") == "video", F.lit(False)) | _column(df, "video_id").isNotNull()


def page_number(df: DataFrame) -> Column:
    p = F.coalesce(_column(df, "page", "double"), _column(df, "page_number", "double"))
    return F.when(p > 0, F.floor(p))


def blocks(df: DataFrame) -> DataFrame:
    """Hits with ``place``, each as a block of header and text."""
    video, named = is_video(df), lambda label, c: F.concat(F.lit(f"{label}: "), T.present(c))
    head = F.concat_ws(
        " | ", F.concat(F.lit("[Source "), F.col("place").cast("string"), F.lit("]")), F.when(video, "Type: Video"), F.when(video, named("Video", F.col("document_title"))).otherwise(named("Document", F.col("document_title"))),
        F.when(video, named("Channel", _column(df, "channel"))), named("Section", F.col("title")), named("Topic", F.col("topic")), named("Subtopic", F.col("subtopic")),
        F.when(~video, F.concat(F.lit("Page: "), page_number(df).cast("string"))), F.when(video, named("Timestamp", T.clock(_column(df, "start_s", "double")))),
    )
    return df.select("place", F.concat(head, F.lit("\n"), F.col("text")).alias("block"))


def built(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row: the context text, its number of sources and its estimated tokens."""
    parts = blocks(within_budget(deduplicated(hits), budget))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), SEPARATOR)
    return parts.agg(text.alias("context"), F.count(F.lit(1)).cast("int").alias("n_sources")).withColumn("tokens", T.token_count(F.col("context")))


def citations(df: DataFrame) -> DataFrame:
    """Hits with ``place`` as sources of an answer."""
    video = is_video(df)
    seconds = _column(df, "start_s", "double")
    return df.select(
        "place", "document_id", F.coalesce("document_title", F.lit("Untitled")).alias("document_name"), F.when(video, "video").otherwise("document").alias("source_type"), F.when(~video, page_number(df)).alias("page"),
        "chunk_id", "chunk_index", T.two_decimals(F.col("score")).alias("score"), F.coalesce(_column(df, "content_preview"), F.substring("text", 1, 300)).alias("highlighted_text"), "topic", "title",
        F.when(video, T.clock(seconds)).alias("timestamp"), F.when(video, F.coalesce(_column(df, "video_url"), T.watch_url(_column(df, "video_id"), seconds))).alias("video_url"),
    )


def sources_markdown(cited: DataFrame) -> DataFrame:
    """One row: the sources as a numbered Markdown list."""
    where = F.when(F.col("source_type") == "video", F.concat(F.lit(" · "), F.col("timestamp"))).otherwise(F.concat(F.lit(" · Page "), F.col("page").cast("string")))
    line = F.concat_ws(
        "\n", F.concat(F.col("place").cast("string"), F.lit(". **"), F.when(F.col("source_type") == "video", "📺 ").otherwise(""), F.col("document_name"), F.lit("**"), F.coalesce(where, F.lit(""))),
        F.concat(F.lit("   - Similarity: "), T.percent(F.col("score"))), F.concat(F.lit("   - Chunk: "), (F.col("chunk_index") + 1).cast("string")), F.concat(F.lit("   - Section: "), T.present(F.col("title"))),
    )
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return cited.agg(F.concat(F.lit("\n\n---\n\n### Sources\n\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n")).alias("markdown"))
