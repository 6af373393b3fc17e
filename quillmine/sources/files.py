"""Files: uploads, notes, video metadata and transcripts in; JSON and Parquet out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.functions import text as T
from quillmine.functions.query import RequestError

#: What may be uploaded, and how much.
SUFFIXES = {"pdf": "application/pdf", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
NO_TITLE, NO_CHANNEL = "Untitled Video", "Unknown Channel"
MOST_BYTES, MOST_TITLE, MOST_NOTE, MOST_TRANSCRIPT, MOST_SECONDS = 10 * 1024 * 1024, 200, 10_000, 500_000, 14_400


def safe_path(folder: str, stored_name: str) -> str:
    """The path of an upload inside its folder; a name that leaves the folder is an error."""
    root = os.path.abspath(folder)
    path = os.path.abspath(os.path.join(root, stored_name))
    if not path.startswith(root + os.sep):
        raise RequestError("Invalid file path")
    return path


def uploads(spark: SparkSession, folder: str, user_id: str) -> DataFrame:
    """Files of the allowed kinds and size, as pending documents with their content; a title is the file's name."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[suffix]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).withColumn("mime", mime)
    rows = rows.where(F.col("mime").isNotNull() & (F.col("length") <= MOST_BYTES))
    return rows.select(
        F.expr("uuid()").alias("document_id"), F.lit(user_id).alias("user_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("title"), T.document_type(F.col("mime")).alias("type"),
        "path", "mime", F.col("length").alias("file_size"), "content", F.lit("pending").alias("extraction_status"), F.col("modificationTime").alias("created_at"),
    )


def notes(raw: DataFrame) -> DataFrame:
    """Inline notes (user_id, title, content) as completed documents; ones with blank or over-long fields are left out."""
    title, content = T.trimmed(F.col("title")), T.trimmed(F.col("content"))
    ok = (F.length(title).between(1, MOST_TITLE)) & (F.length(content).between(1, MOST_NOTE))
    return raw.where(ok).select("user_id", title.alias("title"), F.lit("note").alias("type"), content.alias("extracted_text"), F.lit("completed").alias("extraction_status"))


def video_metadata(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(video_id, title, channel, thumbnail, duration_s) of API answers; longer videos than allowed are left out."""
    kind = "items array<struct<id:string,snippet:struct<title:string,channelTitle:string,thumbnails:struct<high:struct<url:string>,medium:struct<url:string>,default:struct<url:string>>>,contentDetails:struct<duration:string>>>"
    item = F.get(F.from_json(payload, kind)["items"], F.lit(0))
    thumbs = item["snippet"]["thumbnails"]
    out = raw.where(item.isNotNull()).select(
        item["id"].alias("video_id"), F.coalesce(item["snippet"]["title"], F.lit(NO_TITLE)).alias("title"), F.coalesce(item["snippet"]["channelTitle"], F.lit(NO_CHANNEL)).alias("channel"),
        F.coalesce(thumbs["high"]["url"], thumbs["medium"]["url"], thumbs["default"]["url"], F.lit("")).alias("thumbnail"), T.iso_seconds(item["contentDetails"]["duration"]).alias("duration_s"),
    )
    return out.where(F.col("duration_s") <= MOST_SECONDS)


def embed_metadata(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The same from the embedding service's answers, which have no duration; needs the column video_id."""
    p = F.from_json(payload, "title string, author_name string, thumbnail_url string")
    return raw.select("video_id", F.coalesce(p["title"], F.lit(NO_TITLE)).alias("title"), F.coalesce(p["author_name"], F.lit(NO_CHANNEL)).alias("channel"), F.coalesce(p["thumbnail_url"], F.lit("")).alias("thumbnail"), F.lit(None).cast("long").alias("duration_s"))


def metadata_with_fallback(api: DataFrame, embed: DataFrame) -> DataFrame:
    """API rows, and embed rows of the videos that have none."""
    return api.unionByName(embed.join(api.select("video_id"), "video_id", "left_anti"))


def transcript_segments(raw: DataFrame) -> DataFrame:
    """(video_id, i, text, start_s, end_s) of rows with ``segments`` array<struct<text, offset, duration>> in milliseconds; over-long or empty transcripts are left out."""
    size = F.aggregate("segments", F.lit(0), lambda n, s: n + F.coalesce(F.length(s["text"]), F.lit(0)))
    rows = raw.where(size.between(1, MOST_TRANSCRIPT)).select("video_id", F.posexplode("segments").alias("i", "s"))
    return rows.select("video_id", "i", F.col("s.text").alias("text"), (F.col("s.offset") / 1000).alias("start_s"), ((F.col("s.offset") + F.col("s.duration")) / 1000).alias("end_s"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, in the column ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
