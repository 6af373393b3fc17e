"""Transcript cleaning and packing. A transcript has a size limit at its source, so one fits into an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as T

#: Characters of merged segments, tokens of packed ones.
MERGED_CHARS, PACKED_TOKENS = 240, 512


def normalized(segments: DataFrame) -> DataFrame:
    """Segments with tidy text, none empty."""
    return segments.withColumn("text", T.transcript_text(F.col("text"))).where("text <> ''")


def deduplicated(segments: DataFrame) -> DataFrame:
    """Runs of segments of the same text, whatever its case, as one that lasts to their latest end."""
    order = Window.partitionBy("video_id").orderBy("i")
    low = F.lower("text")
    new = segments.withColumn("new", F.coalesce(F.lag(low).over(order) != low, F.lit(True)).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("video_id", "run").agg(F.min("i").alias("i"), F.min_by("text", "i").alias("text"), F.min_by("start_s", "i").alias("start_s"), F.max("end_s").alias("end_s")).drop("run")


def _packed(segments: DataFrame, size, first, step) -> DataFrame:
    """Groups of consecutive segments by a fold: (video_id, part, segments in order). ``step`` gives (opens, carried) for a size."""
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("i", "start_s", "end_s", "text"))).alias("all"))

    def fold(acc, s):
        opens, carried = step(acc["carried"], size(s["text"]))
        starts = F.when(opens | (acc["at"] == 0), F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), carried.cast("int").alias("carried"), (acc["at"] + 1).alias("at"))

    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(first).cast("int").alias("carried"), F.lit(0).alias("at"))
    starts = rows.withColumn("starts", F.aggregate("all", start, fold, lambda a: a["starts"]))
    parts = F.transform("starts", lambda at, k: F.slice("all", at + 1, F.coalesce(F.get("starts", k + 1), F.size("all")) - at))
    return starts.select("video_id", F.posexplode(parts).alias("part", "s"))


def merged(segments: DataFrame, most: int = MERGED_CHARS) -> DataFrame:
    """Neighbours joined while the text with a space between stays within ``most`` characters."""

    def step(carried, n):
        opens = carried + 1 + n > most
        return opens, F.when((carried < 0) | opens, n).otherwise(carried + 1 + n)

    done = _packed(segments, F.length, -1, step)
    return done.select("video_id", F.col("part").alias("i"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), F.col("s")[0]["start_s"].alias("start_s"), F.element_at("s", -1)["end_s"].alias("end_s"))


def cleaned(segments: DataFrame) -> DataFrame:
    return merged(deduplicated(normalized(segments)))


def full_text(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("full_text"))


def searchable_text(segments: DataFrame, title: str) -> DataFrame:
    """A heading and a line with its time for each segment."""
    line = F.concat(F.lit("["), T.minute_clock(F.col("start_s")), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return segments.groupBy("video_id").agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))


def packed(segments: DataFrame, title: str = "Video", most: int = PACKED_TOKENS) -> DataFrame:
    """Chunks of consecutive segments: one is closed before it would exceed ``most`` tokens, and once it has reached them."""

    def step(carried, n):
        opens = (carried >= most) | ((carried > 0) & (carried + n > most)) | ((carried == 0) & (n > most))
        return opens, F.when(opens, n).otherwise(carried + n)

    done = _packed(segments, T.token_count, 0, step)
    text = T.trimmed(F.array_join(F.transform("s", lambda x: x["text"]), " "))
    start, end = F.col("s")[0]["start_s"], F.element_at("s", -1)["end_s"]
    rows = done.select("video_id", F.col("part").alias("chunk_index"), text.alias("text"), start.alias("start_s"), end.alias("end_s"), T.clock(start).alias("start"), T.clock(end).alias("end"))
    name = F.when(F.col("start") == F.col("end"), F.col("start")).otherwise(F.concat_ws(" - ", "start", "end"))
    return rows.select("video_id", "chunk_index", "text", name.alias("title"), F.lit(title).alias("topic"), F.col("start").alias("subtopic"), F.array(F.lit(title), "start").alias("section_path"), F.lit("semantic").alias("level"), T.token_count(F.col("text")).alias("token_count"), T.content_preview(F.col("text")).alias("content_preview"), "start_s", "end_s")
