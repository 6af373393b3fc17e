"""The service's requests as methods over a store of tables. Each is a plan or a few; authentication and HTTP are left to the caller."""

from __future__ import annotations

import secrets
import time
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillmine.functions import query as Q
from quillmine.functions import text as T
from quillmine.operators import chunking, history, retrieval, tables, transcripts
from quillmine.plans import answers, indexing, search
from quillmine.sources import files
from quillmine.sources.adapters import ChatModel, Embedder, Extractor, PlainText, extracted
from quillmine.sources.store import Store

SCHEMAS = {
    "documents": "document_id string, user_id string, title string, type string, extracted_text string, extraction_status string, extraction_error string, index_status string, index_error string, chunk_count int, video_id string, path string, created_at timestamp, updated_at timestamp",
    "chunks": "chunk_id string, document_id string, user_id string, type string, chunk_index int, text string, title string, topic string, subtopic string, section_path array<string>, level string, parent_chunk_index int, parent_chunk_id string, token_count int, content_preview string, keywords array<string>, concepts array<string>, summary string, tags array<string>, searchable_text string, video_id string, start_s double, vector array<double>",
    "segments": "video_id string, i long, text string, start_s double, end_s double",
    "videos": "video_id string, user_id string, document_id string, title string, channel string, thumbnail string, duration_s long, status string",
    "summaries": "cache_key string, document_id string, user_id string, summary string, key_points array<string>, topics array<string>",
    "history": "event_id long, user_id string, query string, result_count int, search_ms long, created_at timestamp",
}


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder, model: ChatModel | None = None, extractors: dict[str, Extractor] | None = None, namespace: str | None = None):
        self.spark, self.embedder, self.model = spark, embedder, model
        self.extractors = extractors or {"note": PlainText()}
        self.store = Store(spark, folder, SCHEMAS, namespace)
        self.queue = ThreadPoolExecutor(1)  # what is queued is lost if the driver ends before it

    # documents

    def _added(self, rows: DataFrame, now: datetime) -> None:
        have = self.store.read("documents")
        filled = rows.withColumns({c: F.lit(None) for c in have.columns if c not in rows.columns}).withColumns({"created_at": T.instant(now), "updated_at": T.instant(now), "index_status": F.lit("pending"), "chunk_count": F.lit(0)})
        self.store.write("documents", tables.merged(have, filled.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in have.schema]), ["document_id"]))

    def create_notes(self, notes: DataFrame, now: datetime) -> None:
        """Add notes (user_id, title, content) and index them."""
        made = files.notes(notes)
        rows = made.withColumn("document_id", F.sha2(F.concat_ws("\u0001", "user_id", "title", "extracted_text", F.lit(now.isoformat())), 256)).withColumn("extracted_text", chunking.clean_text(F.col("extracted_text")))
        self._added(rows, now)
        self.index(F.col("index_status") == "pending", now)

    def _extract(self, files_: DataFrame) -> DataFrame:
        done = extracted(files_.select("document_id", "user_id", "title", "type", "path", "content"), self.extractors)
        return done.withColumn("extracted_text", chunking.clean_text(F.col("extracted_text")))

    def upload(self, folder: str, user_id: str, now: datetime) -> None:
        """Add the allowed files of a folder, extract their texts and index those that have one. While a file is read its document is ``processing``."""
        found = files.uploads(self.spark, folder, user_id).withColumn("document_id", F.sha2(F.concat_ws("\u0001", F.lit(user_id), "path"), 256))
        self._added(found.select("document_id", "user_id", "title", "type", "path", F.lit("processing").alias("extraction_status")), now)
        with self.store.kept(self._extract(found)) as done:
            self._added(done, now)
        self.index(F.col("index_status") == "pending", now)

    def reindex(self, user_id: str, document_id: str, now: datetime) -> None:
        """Index a document again; its file is read again if it has no text yet, and without a text it has failed."""
        row = self.document(user_id, document_id)
        if (row["extraction_status"] != "completed" or not (row["extracted_text"] or "").strip()) and row["path"]:
            one = self.store.read("documents").where(F.col("document_id") == document_id).select("document_id", "user_id", "title", "type")
            content = self.spark.read.format("binaryFile").load(row["path"]).select(F.lit(document_id).alias("document_id"), "path", "content")
            with self.store.kept(self._extract(one.join(content, "document_id"))) as done:
                self.store.write("documents", tables.merged(self.store.read("documents"), done.select("document_id", "extracted_text", "extraction_status", "extraction_error"), ["document_id"]))
        if not (self.document(user_id, document_id)["extracted_text"] or "").strip():
            why = F.coalesce("extraction_error", F.lit("Text extraction must complete before indexing")).alias("index_error")
            failed = self.store.read("documents").where(F.col("document_id") == document_id).select("document_id", F.lit("failed").alias("index_status"), why)
            self.store.write("documents", tables.merged(self.store.read("documents"), failed, ["document_id"]))
            return
        self.index(F.col("document_id") == document_id, now)

    def queued_reindex(self, user_id: str, document_id: str, now: datetime) -> Future:
        """``reindex`` in the background, one after another."""
        self.document(user_id, document_id)
        return self.queue.submit(self.reindex, user_id, document_id, now)

    def wait_indexed(self, user_id: str, document_id: str, timeout_s: float = 120, poll_s: float = 0.5) -> str:
        """The state of a document once it is indexed or has failed."""
        end = time.monotonic() + timeout_s
        while (state := self.index_status(user_id, document_id)["index_status"]) not in ("indexed", "failed"):
            if time.monotonic() >= end:
                raise Q.RequestError("Indexing timed out", 504)
            time.sleep(poll_s)
        return state

    def import_video(self, user_id: str, url: str, metadata: DataFrame, raw: DataFrame, now: datetime) -> str:
        """Add a video with its transcript (see sources.files) and index it; one that the owner has already is left alone."""
        row = self.spark.createDataFrame([(url,)], "u string").select(T.video_id(F.col("u")).alias("v")).first()
        if row["v"] is None or len(url) > 500:
            raise Q.RequestError("Invalid video URL")
        video, key = row["v"], f"{user_id}:{row['v']}"
        if not self.store.read("videos").where((F.col("user_id") == user_id) & (F.col("video_id") == video) & (F.col("status") == "indexed")).isEmpty():
            return key
        seg = transcripts.cleaned(files.transcript_segments(raw.where(F.col("video_id") == video)))
        self.store.write("segments", tables.replaced(self.store.read("segments"), seg.withColumn("i", F.col("i").cast("long")), "video_id"))
        seg = self.store.read("segments").where(F.col("video_id") == video)
        last = F.ceil(F.lit(seg.agg(F.max("end_s").alias("e")).first()["e"]).cast("double"))
        state = F.lit("no_transcript" if seg.isEmpty() else "pending")
        new = metadata.where(F.col("video_id") == video).select("video_id", F.lit(user_id).alias("user_id"), F.lit(key).alias("document_id"), "title", "channel", "thumbnail", F.coalesce("duration_s", last).alias("duration_s"), state.alias("status"))
        self.store.write("videos", tables.merged(self.store.read("videos"), new, ["video_id", "user_id"]))
        text = transcripts.searchable_text(seg, "Transcript").select("video_id", F.col("text").alias("extracted_text"))
        self._added(new.join(text, "video_id").select("document_id", "user_id", "title", F.lit("video").alias("type"), "extracted_text", F.lit("completed").alias("extraction_status"), "video_id"), now)
        self.index(F.col("document_id") == key, now)
        return key

    def index(self, which: Column, now: datetime) -> None:
        """Index documents anew: their chunks are replaced, and document and video get the outcome."""
        docs = self.store.read("documents")
        some = docs.where(which & F.col("extracted_text").isNotNull())
        made = indexing.indexed(some.select("document_id", "title", "extracted_text", "video_id"), self.embedder, self.store.read("segments"))
        made = made.join(some.select("document_id", "user_id", "type"), "document_id")
        have = self.store.read("chunks")
        made = made.withColumns({c: F.lit(None) for c in have.columns if c not in made.columns}).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in have.schema], "error")
        with self.store.kept(made) as once:  # two tables follow from it, and each text is embedded once
            chunks, state = indexing.reindexed(have, docs, once)
            self.store.write("chunks", chunks)
            self.store.write("documents", state.withColumn("updated_at", F.when(which, T.instant(now)).otherwise(F.col("updated_at"))))
        videos, known = self.store.read("videos"), self.store.read("documents").select("document_id", "index_status")
        self.store.write("videos", videos.join(known, "document_id", "left").withColumn("status", F.when(F.col("index_status").isin("indexed", "failed"), F.col("index_status")).otherwise(F.col("status"))))

    def document(self, user_id: str, document_id: str) -> Row:
        row = self.store.read("documents").where(F.col("document_id") == document_id).first()
        if row is None:
            raise Q.RequestError("Document not found", 404)
        if row["user_id"] != user_id:
            raise Q.RequestError("Access denied", 403)
        return row

    def documents(self, user_id: str) -> DataFrame:
        return self.store.read("documents").where(F.col("user_id") == user_id).drop("extracted_text").orderBy(F.desc("created_at"), "document_id")

    def chunks(self, user_id: str, document_id: str) -> DataFrame:
        self.document(user_id, document_id)
        return self.store.read("chunks").where(F.col("document_id") == document_id).drop("vector", "searchable_text").orderBy("chunk_index")

    def index_status(self, user_id: str, document_id: str) -> dict:
        row = self.document(user_id, document_id)
        return {"index_status": row["index_status"] or "pending", "index_error": row["index_error"], "chunk_count": row["chunk_count"] or 0}

    def reprocess(self, user_id: str, document_id: str, now: datetime) -> Future | None:
        """Notes are indexed at once, other documents in the background."""
        if self.document(user_id, document_id)["type"] != "note":
            return self.queued_reindex(user_id, document_id, now)
        return self.index(F.col("document_id") == document_id, now)

    def delete_document(self, user_id: str, document_id: str) -> None:
        self.document(user_id, document_id)
        for name, left in tables.without_document({n: self.store.read(n) for n in ("chunks", "videos", "summaries", "documents")}, document_id, user_id).items():
            self.store.write(name, left)

    def document_stats(self, user_id: str) -> Row | None:
        return history.document_stats(self.store.read("documents"), self.store.read("chunks")).where(F.col("user_id") == user_id).first()

    # search

    def search(self, user_id: str, text: str, now: datetime, page: object = 1, limit: object = 20, f: Q.Filter | None = None) -> list[Row]:
        """A page of results, which the search history then holds."""
        began, asked = time.monotonic(), Q.checked_query(text)
        chunks, docs = self.store.read("chunks"), self.store.read("documents")
        ids = search.allowed_documents(docs, user_id, f or Q.Filter(), now)
        rows = []
        if ids is None or not ids.isEmpty():
            rows = search.search(chunks.drop("vector"), docs, chunks.select("chunk_id", "vector"), user_id, asked, self.embedder.embed([asked])[0], now, page, limit, f).orderBy("place").collect()
        took = int((time.monotonic() - began) * 1000)
        new = self.spark.createDataFrame([(secrets.randbits(62), user_id, asked, rows[0]["total"] if rows else 0, took)], "event_id long, user_id string, query string, result_count int, search_ms long")
        self.store.append("history", new.withColumn("created_at", T.instant(now)))
        return rows

    def _history(self) -> DataFrame:
        """The searches that count, of all that were appended."""
        return history.latest(history.deduplicated(self.store.read("history"))).drop("place")

    def compact_history(self) -> None:
        """Rewrite the history without what counts no more; a batch job, for when no search is running."""
        old = self.store.read("history")
        self.store.write("history", old.join(self._history().select("event_id"), "event_id", "left_semi"))

    def recent_searches(self, user_id: str) -> DataFrame:
        return self._history().where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("event_id"))

    def forget(self, user_id: str, event_id: int | None = None) -> int:
        """Delete one search, with earlier ones of the same query, or all of an owner; returns how many counted."""
        own = self._history().where(F.col("user_id") == user_id)
        gone = own if event_id is None else own.where(F.col("event_id") == event_id)
        n = gone.count()
        if n == 0 and event_id is not None:
            raise Q.RequestError("Search history item not found", 404)
        old = self.store.read("history")
        self.store.write("history", history.without(old, user_id) if event_id is None else old.join(gone.select("user_id", "query"), ["user_id", "query"], "left_anti"))
        return n

    def search_stats(self, user_id: str, now: datetime) -> Row | None:
        return history.search_stats(self._history(), now).where(F.col("user_id") == user_id).first()

    # answers

    def ask(self, user_id: str, question: object, top_k: int = retrieval.ANSWER_HITS, document_ids: Sequence[object] = ()) -> answers.Answer:
        """Answer from the nearest chunks, of these documents if any are named."""
        asked = Q.checked_question(question)
        chunks, docs = self.store.read("chunks"), self.store.read("documents")
        named = [d for d in document_ids if isinstance(d, str)]
        ids = docs.where(F.col("document_id").isin(*named)) if named else None
        hits = answers.retrieved(chunks.drop("vector"), chunks.select("chunk_id", "vector"), user_id, self.embedder.embed([asked])[0], top_k, documents=ids)
        return answers.answer(answers.titled(hits, docs), asked, self.model)

    def summary(self, user_id: str, document_id: str) -> Row:
        """(summary, key_points, topics), from the table of summaries if the document has not changed since."""
        self.document(user_id, document_id)
        key = answers.summary_key(self.store.read("documents").where(F.col("document_id") == document_id)).first()["cache_key"]
        held = self.store.read("summaries").where(F.col("cache_key") == key).select("summary", "key_points", "topics").first()
        if held is not None:
            return held
        made = answers.summarize(self.store.read("chunks"), document_id, self.model, self.spark)
        new = self.spark.createDataFrame([(key, document_id, user_id, made["summary"], made["key_points"], made["topics"])], SCHEMAS["summaries"])
        self.store.write("summaries", tables.replaced(self.store.read("summaries"), new))
        return made

    def forget_summary(self, document_id: str) -> None:
        """The next summary of this document is made anew."""
        self.store.write("summaries", self.store.read("summaries").where(F.col("document_id") != document_id))


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)
