"""What the queries of the catalogue share: their register, the request that they stand for, and SQL of views and expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions import query as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The request that the queries stand for: an owner, a query and the stored vector that stands for its embedding.
USER, QUERY, VECTOR = "u0", 'reti thea "of the" and', 7
TERMS, PHRASES = Q.tokens(QUERY), Q.phrases(QUERY)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def shown(df: DataFrame, *names: str | Column) -> DataFrame:
    """Scores rounded, times as text."""
    out = df.select(*names) if names else df
    kinds = dict(out.dtypes)
    return out.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in out.columns])


# SQL of the views in quillmine.sources.tables and of shared expressions


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def preview(x: str) -> str:
    return f"CASE WHEN length({flat(x)}) <= 200 THEN {flat(x)} ELSE trim(substring({flat(x)}, 1, 197)) || '...' END"


def tokens(x: str) -> str:
    return f"CASE WHEN trim({x}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE CAST(ceil(length({x}) / 4.0) AS INTEGER) END"


def share(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce({x}, '')), '{t}') AS INTEGER)" for t in terms) + f") / {len(terms)}.0"


CHUNKS = f"""chunks AS (SELECT doc_id AS chunk_id, doc_id // 4 AS document_id, CAST(doc_id % 4 AS INTEGER) AS chunk_index,
  'u' || ((doc_id // 4) % 2) AS user_id, text, substring(split_part(text, chr(10), 1), 1, 80) AS title, 'topic ' || (doc_id % 10) AS topic,
  lang AS subtopic, lang || ' ' || source AS tags, lang AS type, {preview("text")} AS content_preview FROM documents)"""
DOCS = """docs AS (SELECT c.document_id, c.user_id, c.title, c.type, TIMESTAMP '2024-01-31' - to_days(CAST(c.document_id % 120 AS INTEGER)) AS created_at,
  CASE l.quality WHEN 1 THEN 'indexed' WHEN 0 THEN 'failed' ELSE 'pending' END AS index_status
  FROM chunks c LEFT JOIN labels l ON l.doc_id = c.chunk_id WHERE c.chunk_index = 0)"""
SCORED = f"""scored AS (SELECT vec_id AS chunk_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {VECTOR})) AS score FROM embeddings)"""
KEYWORD = " + ".join(
    f"CASE WHEN regexp_matches(lower({field}), '(^|\\W){t}(\\W|$)') THEN {w} ELSE 0 END"
    for field, w in (("title", 10), ("topic", 8), ("subtopic", 6), ("tags", 4), ("text", 1))
    for t in TERMS
)
HISTORY = "history AS (SELECT event_id, user_id, event_type || ':' || json_extract_string(props, '$.k') AS query, CAST(floor(value) AS INTEGER) AS result_count, ts AS created_at FROM events)"
SEGMENTS = """segments AS (SELECT conv_id AS video_id, turn AS i, text, (read_to - length(text)) / 15.0::DOUBLE AS start_s, read_to / 15.0::DOUBLE AS end_s
  FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS read_to FROM conversations))"""
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S') AS {}"

FOLD = """rows AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY i) AS r, {size} AS n FROM {source}),
fold AS (SELECT video_id, r, 0 AS part, {first} AS carried FROM rows WHERE r = 1
  UNION ALL SELECT x.video_id, x.r, f.part + CASE WHEN {opens} THEN 1 ELSE 0 END, CASE WHEN {opens} THEN x.n ELSE {joined} END FROM fold f JOIN rows x ON x.video_id = f.video_id AND x.r = f.r + 1)"""
PACK = FOLD.format(size=tokens("text"), source="segments", first="n", opens="f.carried >= 512 OR f.carried + x.n > 512", joined="f.carried + x.n")
CLOCK = "CASE WHEN {0} >= 3600 THEN printf('%02d:', CAST(floor({0} / 3600) AS BIGINT)) ELSE '' END || printf('%02d:%02d', CAST(floor({0} % 3600 / 60) AS BIGINT), CAST(floor({0}) % 60 AS BIGINT))"
