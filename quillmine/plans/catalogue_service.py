"""More queries of the engine with their SQL: what it takes in, writes, links and formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions import text as T
from quillmine.operators import context, retrieval, tables, transcripts
from quillmine.plans import answers, indexing
from quillmine.plans import chunk_sql as C
from quillmine.plans import parts as P
from quillmine.plans.parts import query
from quillmine.sources import files
from quillmine.sources import tables as S
from quillmine.sources.adapters import PlainText, embedded, extracted


# what comes in


@query(f"""SELECT user_id, title, 'note' AS type, content AS extracted_text, 'completed' AS extraction_status FROM
  (SELECT 'u' || (doc_id % 3) AS user_id, {C.stripped("lang || ' ' || source || ' '")} AS title, {C.stripped("text")} AS content FROM documents) WHERE length(title) BETWEEN 1 AND 200 AND length(content) BETWEEN 1 AND 10000""")
def note_rows(spark, d):
    raw = S.read(spark, d, "documents").select(F.concat(F.lit("u"), (F.col("doc_id") % 3).cast("string")).alias("user_id"), F.concat("lang", F.lit(" "), "source", F.lit(" ")).alias("title"), F.col("text").alias("content"))
    return files.notes(raw)


@query(f"SELECT doc_id, {C.flat('text')} AS text FROM documents")
def sanitize_input(spark, d):
    """Control characters are put into the texts, and taken out by the operator."""
    odd = F.replace(F.replace("text", F.lit("a"), F.lit("\u0001a")), F.lit("."), F.lit(".\u007f"))
    return S.read(spark, d, "documents").select("doc_id", T.sanitized(odd).alias("text"))


@query(f"""SELECT doc_id AS document_id, kind AS type, CASE WHEN kind = 'pdf' THEN nullif({C.stripped("text")}, '') END AS extracted_text, CASE WHEN kind <> 'pdf' THEN 'Unsupported document type: image' WHEN {C.stripped("text")} = '' THEN 'No extractable text' END AS extraction_error,
  CASE WHEN kind = 'pdf' AND {C.stripped("text")} <> '' THEN 'completed' ELSE 'failed' END AS extraction_status FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'pdf' END AS kind FROM documents)""")
def extract_texts(spark, d):
    mime = F.when(F.col("doc_id") % 3 == 0, "image/png").otherwise("application/pdf")
    rows = S.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), T.document_type(mime).alias("type"), F.encode("text", "UTF-8").alias("content"))
    return extracted(rows, {"pdf": PlainText()})


class _Sizes:
    """An embedder whose vectors SQL can tell: characters, and characters that are no spaces."""

    dimension, gap_s = 2, 0.0

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[float(len(t)), float(len(t.replace(" ", "")))] for t in texts]


@query(f"""SELECT doc_id, CASE WHEN t <> '' THEN CAST(length(t) AS DOUBLE) END AS size, CASE WHEN t <> '' THEN CAST(length(replace(t, ' ', '')) AS DOUBLE) END AS letters, CASE WHEN t = '' THEN 'Text is empty' END AS error
  FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE {C.stripped("text")} END AS t FROM documents)""")
def embed_batches(spark, d):
    rows = S.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("embedding_text"))
    return embedded(rows, _Sizes()).select("doc_id", F.get("vector", F.lit(0)).alias("size"), F.get("vector", F.lit(1)).alias("letters"), "error")


@query("""SELECT 'v' || event_id AS video_id, CASE WHEN event_id % 4 = 0 THEN 'Untitled Video' ELSE event_type END AS title, 'user ' || user_id AS channel, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'small' END AS thumbnail, event_id % 14401 AS duration_s FROM events WHERE event_id % 5 <> 0
  UNION ALL SELECT 'v' || event_id, event_type, 'Unknown Channel', '', NULL FROM events WHERE event_id % 5 = 0""")
def video_metadata(spark, d):
    """Answers of the data interface, without items for every fifth video, for which the embedding interface stands in."""
    e = S.read(spark, d, "events")
    n, video = F.col("event_id"), F.concat(F.lit("v"), F.col("event_id").cast("string"))
    thumbs = F.struct(F.when(n % 2 == 0, F.struct(F.lit("high").alias("url"))).alias("high"), F.struct(F.lit("small").alias("url")).alias("default"))
    item = F.struct(video.alias("id"), F.struct(F.when(n % 4 != 0, F.col("event_type")).alias("title"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("channelTitle"), thumbs.alias("thumbnails")).alias("snippet"), F.struct(F.concat(F.lit("PT"), (n % 14401).cast("string"), F.lit("S")).alias("duration")).alias("contentDetails"))
    api = e.select(F.to_json(F.struct(F.filter(F.array(item), lambda _: n % 5 != 0).alias("items"))).alias("payload"))
    plain = e.where(n % 5 == 0).select(video.alias("video_id"), F.to_json(F.struct(F.col("event_type").alias("title"))).alias("payload"))
    return files.metadata_with_fallback(files.video_metadata(api), files.embed_metadata(plain))


@query("SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS i, text, round(turn * 1.5::DOUBLE, 6) AS start_s, round(turn * 1.5::DOUBLE + length(text) / 1000.0::DOUBLE, 6) AS end_s FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING sum(length(text)) BETWEEN 1 AND 500000)")
def transcript_rows(spark, d):
    turn = F.struct("turn", F.col("text"), (F.col("turn") * 1500.0).alias("offset"), F.length("text").cast("double").alias("duration"))
    raw = S.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(turn)).alias("all"))
    raw = raw.select("video_id", F.transform("all", lambda s: F.struct(s["text"].alias("text"), s["offset"].alias("offset"), s["duration"].alias("duration"))).alias("segments"))
    return P.shown(files.transcript_segments(raw), "video_id", "i", "text", "start_s", "end_s")


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_sink(spark, d):
    """Rows as JSON lines, read back from them."""
    rows = S.read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return files.as_json(rows).select(F.from_json("value", rows.schema).alias("r")).select("r.*")


# tables


@query(f"WITH {P.CHUNKS} SELECT chunk_id, document_id FROM chunks WHERE NOT (chunk_id IN (1, 2, 3, 5, 8, 13, 21) AND user_id = '{P.USER}')")
def delete_vectors(spark, d):
    return tables.deleted(S.chunks(spark, d), [1, 2, 3, 5, 8, 13, 21, -1], owner=P.USER).select("chunk_id", "document_id")


@query("SELECT page_id, url FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'new' FROM pages WHERE page_id % 3 = 0")
def insert_absent(spark, d):
    """Pages are offered anew; those that are there stay as they are."""
    pages = S.read(spark, d, "pages").select("page_id", "url")
    return tables.inserted(pages.where("page_id % 3 > 0"), pages.withColumn("url", F.lit("new")), ["page_id"])


@query(f"""WITH {P.CHUNKS}, {P.DOCS}, r AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE chunk_id % 3 = 0 OR document_id % 5 = 0) AS bad FROM chunks WHERE document_id % 2 = 0 GROUP BY document_id)
SELECT document_id, CASE WHEN n IS NULL THEN index_status WHEN bad = n THEN 'failed' ELSE 'indexed' END AS index_status, CASE WHEN n IS NULL THEN 0 ELSE n - bad END AS chunk_count, CASE WHEN bad > 0 THEN 'no vector' END AS index_error FROM docs LEFT JOIN r USING (document_id)""")
def index_states(spark, d):
    results = S.chunks(spark, d).where("document_id % 2 = 0").select("document_id", F.when((F.col("chunk_id") % 3 == 0) | (F.col("document_id") % 5 == 0), "no vector").alias("error"))
    return tables.with_index_state(S.documents(spark, d), results).select("document_id", "index_status", F.col("chunk_count").cast("long").alias("chunk_count"), "index_error")


@query(f"WITH {P.CHUNKS} SELECT chunk_id, user_id, document_id, chunk_index, topic, CASE WHEN chunk_id % 2 = 0 THEN subtopic ELSE '' END AS subtopic, title, type AS source_type, lower(tags) AS tags FROM chunks")
def vector_metadata(spark, d):
    rows = S.chunks(spark, d).withColumns({"subtopic": F.when(F.col("chunk_id") % 2 == 0, F.col("subtopic")), "tags": F.transform("tags", F.upper)})
    return indexing.vector_metadata(rows).withColumn("tags", F.array_join("tags", " "))


@query(f"WITH {P.CHUNKS}, {P.DOCS} SELECT document_id, document_id || ':' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS cache_key FROM docs")
def summary_keys(spark, d):
    return answers.summary_key(S.documents(spark, d).withColumn("updated_at", F.col("created_at")))


# hits and answers


@query(f"WITH {P.SCORED}, hits AS (SELECT chunk_id, score FROM scored WHERE score >= 0 ORDER BY score DESC, chunk_id LIMIT 40) SELECT chunk_id, round(score, 6) AS vector_score, 0.0::DOUBLE AS keyword_score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS vector_rank, round(score, 6) AS rrf_score FROM hits")
def vector_only_hits(spark, d):
    hits = retrieval.vector_hits(S.vectors(spark, d), S.vector_of(spark, d, P.VECTOR), 40).select("chunk_id", "score")
    return P.shown(retrieval.vector_only(hits), "chunk_id", "vector_score", "keyword_score", "vector_rank", "rrf_score")


def _video_hits(spark: SparkSession, d: str) -> DataFrame:
    """Packed transcript chunks as hits, the longer the better."""
    packed = transcripts.packed(S.segments(spark, d), "Talk").withColumnRenamed("video_id", "document_id")
    return packed.withColumns({"chunk_id": F.concat_ws(":", "document_id", "chunk_index"), "score": F.least(F.col("token_count"), F.lit(400)) / 800, "document_title": F.concat(F.lit("Talk "), F.col("document_id").cast("string")), "type": F.lit("video"), "video_id": F.concat(F.lit("v"), F.col("document_id").cast("string")), "channel": F.lit("Hall")})


_VIDEOS = f"""{P.SEGMENTS}, {P.PACK}, packed AS (SELECT video_id AS document_id, CAST(part AS INTEGER) AS chunk_index, trim(string_agg(text, ' ' ORDER BY r)) AS text, min(start_s) AS a, arg_max(end_s, r) AS b FROM fold JOIN rows USING (video_id, r) GROUP BY video_id, part),
clocked AS (SELECT *, {P.CLOCK.format('a')} AS s, {P.CLOCK.format('b')} AS e, {C.tokens('text')} AS n FROM packed),
hits AS (SELECT *, document_id || ':' || chunk_index AS chunk_id, least(n, 400) / 800.0::DOUBLE AS score, 'Talk ' || document_id AS document_title, CASE WHEN s = e THEN s ELSE s || ' - ' || e END AS title FROM clocked),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM hits),
costed AS (SELECT *, sum({C.tokens("'[Source] ' || document_title || ' ' || title")} + n + 8) OVER (ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM top WHERE place <= 501)),
cited AS (SELECT * FROM costed WHERE place = 1 OR used <= 4000)"""
_URL = "'https://www.youtube.com/watch?v=v' || document_id || CASE WHEN a > 0 THEN '&t=' || CAST(floor(a) AS BIGINT) || 's' ELSE '' END"


@query(f"""WITH RECURSIVE {_VIDEOS} SELECT CAST(place AS INTEGER) AS place, document_id, document_title AS document_name, 'video' AS source_type, chunk_id, chunk_index, round(floor(score * 100 + 0.5) / 100, 6) AS score, 'Talk' AS topic, title, s AS timestamp, {_URL} AS video_url FROM cited""")
def video_sources(spark, d):
    cited = context.citations(context.within_budget(context.deduplicated(_video_hits(spark, d))))
    return P.shown(cited, "place", "document_id", "document_name", "source_type", "chunk_id", "chunk_index", "score", "topic", "title", "timestamp", "video_url")


_VIDEO_BLOCK = "'[Source ' || place || '] | Type: Video | Video: ' || document_title || ' | Channel: Hall | Section: ' || title || ' | Topic: Talk | Subtopic: ' || s || ' | Timestamp: ' || s || chr(10) || text"


@query(f"WITH RECURSIVE {_VIDEOS}, t AS (SELECT string_agg({_VIDEO_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context, CAST(count(*) AS INTEGER) AS n_sources FROM cited) SELECT context, n_sources, {C.tokens('context')} AS tokens FROM t")
def video_context(spark, d):
    return context.built(_video_hits(spark, d))


@query(f"""WITH RECURSIVE {_VIDEOS} SELECT chr(10) || chr(10) || '---' || chr(10) || chr(10) || '### Sources' || chr(10) || chr(10) || string_agg(place || '. **📺 ' || document_title || '** · ' || s || chr(10) || '   - Similarity: ' || CAST(floor(least(greatest(floor(score * 100 + 0.5) / 100, 0), 1) * 100 + 0.5) AS BIGINT) || '%' || chr(10)
  || '   - Chunk: ' || (chunk_index + 1) || chr(10) || '   - Section: ' || title, chr(10) || chr(10) ORDER BY place) AS markdown FROM cited""")
def sources_markdown(spark, d):
    return context.sources_markdown(context.citations(context.within_budget(context.deduplicated(_video_hits(spark, d)))))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'https://www.youtube.com/watch?v=v' || event_id || CASE WHEN event_id % 3 = 1 THEN '&t=' || (event_id % 100) || 's' ELSE '' END END AS link FROM events")
def video_links(spark, d):
    n = F.col("event_id")
    return S.read(spark, d, "events").select("event_id", T.video_link(F.when(n % 3 == 0, "own"), F.concat(F.lit("v"), n.cast("string")), F.when(n % 3 == 1, (n % 100).cast("double"))).alias("link"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'Image' WHEN 2 THEN 'Note' WHEN 3 THEN 'Video' ELSE 'other' END AS label FROM documents")
def type_labels(spark, d):
    kinds = F.array(*map(F.lit, ("pdf", "image", "note", "video", "other")))
    return S.read(spark, d, "documents").select("doc_id", T.type_label(F.get(kinds, (F.col("doc_id") % 5).cast("int"))).alias("label"))


@query(f"""WITH RECURSIVE source AS (SELECT doc_id AS document_id, text, 'D ' || doc_id AS title FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)), {C.TOPICS}, {P.SEGMENTS}, {P.PACK},
v AS (SELECT video_id AS document_id, CAST(part AS INTEGER) AS chunk_index, trim(string_agg(text, ' ' ORDER BY r)) AS text, min(start_s) AS a FROM fold JOIN rows USING (video_id, r) WHERE video_id IN (SELECT doc_id FROM documents) GROUP BY video_id, part)
SELECT document_id, chunk_index, text, topic FROM topics UNION ALL SELECT document_id, chunk_index, text, 'D ' || document_id FROM v""")
def indexed_chunks(spark, d):
    """Documents whose number is a conversation's are its video, and packed by time; the others are chunked by topic."""
    docs = S.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("extracted_text"))
    segments = S.segments(spark, d)
    known = docs.join(segments.select(F.col("video_id").alias("document_id")).distinct().withColumn("video_id", F.col("document_id")), "document_id", "left")
    return indexing.chunks_of(known, segments).select("document_id", "chunk_index", "text", "topic")
