"""Column expressions for tokenising, scoring, cleaning, enriching and formatting text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could "
    "should may might must shall can this that these those it its they them their we our you your i my me about into through during "
    "before after above below between under again further then once here there when where why how all each few more most other some "
    "such no nor not only own same so than too very just also now what which who whom learn learned note notes"
).split()
#: Hosts of video pages.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be")
#: What counts as a name in Pascal case, a term in backticks, a first sentence, a duration, a video's id and its place in a path.
PASCAL_CASE, BACKTICKS = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:[A-Z][a-z]+)+(?![A-Za-z0-9_])", r"`([^`]+)`"
FIRST_SENTENCE, DURATION = r"^[^.!?]++[.!?]+", r"(?i)PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"
VIDEO_ID, VIDEO_PATH = r"^[a-zA-Z0-9_-]{11}$", r"^/(?:embed|shorts|live|v)/([a-zA-Z0-9_-]{11})"
CONTROL, WATCH = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "https://www.youtube.com/watch?v="
#: Days until a document's recency is 0, characters of previews and summaries, numbers of concepts and tags.
RECENT_DAYS, PREVIEW, SNIPPET, SUMMARY = 90, 200, (200, 300), 240
NAMES, CODES, TAG_WORDS, MOST_TAGS = 8, 6, 6, 15
_SPACE = r"(?U)\s+"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) where f uses its argument several times and it is costly."""
    return F.transform(F.array(value), f)[0]


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def present(c: Column) -> Column:
    """Null instead of an empty string, as concat_ws leaves out null alone."""
    return F.nullif(c, F.lit(""))


def share_contained(text: Column, terms: Sequence[str]) -> Column:
    """Which share of the terms occurs in the lower-cased text; repeated terms count again, 0 without terms or text."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def query_tokens(query: Column) -> Column:
    """Terms of a query column: lower case, split at white space, ASCII word characters and hyphens kept, two characters at least."""
    parts = F.transform(F.split(F.lower(query), _SPACE), lambda x: F.regexp_replace(x, r"[^\w-]", ""))
    return F.filter(parts, lambda x: F.length(x) >= 2)


def has_token(text: Column, term: str) -> Column:
    """Whether a term is one of the text's ASCII word tokens."""
    low = F.lower(text)
    return F.coalesce(F.contains(low, F.lit(term)) & low.rlike(rf"(^|\W){term}(\W|$)"), F.lit(False))  # the pattern runs only where the term occurs


def instant(t: datetime) -> Column:
    """A literal instant of the session's time zone."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp")


def recency(created: Column, now: Column) -> Column:
    """1 for now, falling to 0 over 90 days; above 1 for the future."""
    return F.greatest(F.lit(0.0), 1 - (F.unix_millis(now) - F.unix_millis(created)) / 86400000 / RECENT_DAYS)


def token_count(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up; 0 for blank text."""
    return F.when(trimmed(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.ceil(F.length(c) / 4)).cast("int")


def tokens_of_words(n: Column) -> Column:
    return F.ceil(n * 1.3).cast("int")


def content_preview(c: Column, most: int = PREVIEW) -> Column:
    flat = collapsed(c)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.trim(F.substring(flat, 1, most - 3)), F.lit("...")))


def preview_snippet(text: Column, terms: Sequence[str], least: int = SNIPPET[0], most: int = SNIPPET[1]) -> Column:
    """A part of the text around the first query term that it contains (in the order of the terms), with dots where it is cut."""

    def around(flat: Column, anchor: Column) -> Column:
        start = F.greatest(F.lit(0), anchor - most // 2)
        end = F.least(F.length(flat), start + most)
        start = F.when(end - start < least, F.greatest(F.lit(0), end - least)).otherwise(start)
        part = F.trim(F.substring(flat, start + 1, end - start))
        return F.concat(F.when(start > 0, "...").otherwise(""), part, F.when(end < F.length(flat), "...").otherwise(""))

    def shown(flat: Column) -> Column:
        anchor = once(F.lower(flat), lambda low: F.coalesce(*[F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in terms], F.lit(0)))
        return F.when(F.length(flat) <= most, flat).otherwise(once(anchor, lambda a: around(flat, a)))

    return once(collapsed(text), shown)


def without_extra_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\S\n]+", " ")


def without_repeated_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def sanitized(c: Column) -> Column:
    """User input without control characters."""
    return collapsed(F.regexp_replace(c, CONTROL, ""))


def transcript_text(c: Column) -> Column:
    """One transcript segment: spaces collapsed, none before punctuation, of a run of punctuation the last sign."""
    flat = collapsed(F.regexp_replace(F.regexp_replace(c, _SPACE, " "), "​", ""))
    return trimmed(F.regexp_replace(F.regexp_replace(flat, r"(?U)\s+([.,!?;:])", "$1"), r"([.,!?;:])+", "$1"))


def words(c: Column) -> Column:
    """Lower-case ASCII words of three characters or more that are no stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(c), r"\W+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def concepts(text: Column, section_path: Column, topic: Column, subtopic: Column) -> Column:
    """Section titles, then 8 identifiers in Pascal case, then 6 terms in backticks; each once, none empty."""
    named = F.slice(F.regexp_extract_all(text, F.lit(PASCAL_CASE), F.lit(0)), 1, NAMES)
    code = F.transform(F.slice(F.regexp_extract_all(text, F.lit(BACKTICKS), F.lit(1)), 1, CODES), trimmed)
    return F.array_distinct(F.filter(F.concat(F.coalesce(section_path, F.array().cast("array<string>")), F.array(subtopic, topic), named, code), lambda x: x.isNotNull() & (x != "")))


def summary(text: Column, title: Column) -> Column:
    """The first sentence, 240 characters at most, after the title unless it holds it."""
    first = lambda flat: F.trim(F.coalesce(present(F.regexp_extract(F.regexp_replace(flat, r"^[.!?]+", ""), FIRST_SENTENCE, 0)), flat))
    short = lambda one: F.when(F.length(one) > SUMMARY, F.concat(F.trim(F.substring(one, 1, SUMMARY - 3)), F.lit("..."))).otherwise(one)
    full = lambda one: F.when(F.contains(F.lower(one), F.lower(title)), one).otherwise(F.concat(title, F.lit(": "), one))
    return once(once(once(collapsed(text), first), short), full)


def tags(topic: Column, subtopic: Column, level: Column, keywords: Column) -> Column:
    named = F.filter(F.array(F.lower(topic), F.lower(present(subtopic)), present(level)), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(named, F.slice(keywords, 1, TAG_WORDS))), 1, MOST_TAGS)


def embedding_text(topic: Column, subtopic: Column, title: Column, summary: Column, keywords: Column, text: Column) -> Column:
    lines = [("Topic", topic), ("Subtopic", present(subtopic)), ("Title", title), ("Summary", summary), ("Keywords", F.array_join(keywords, ", "))]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), c) for name, c in lines], present(text))


def searchable_text(title: Column, topic: Column, subtopic: Column, summary: Column, keywords: Column, concepts: Column, tags: Column, section_path: Column, text: Column, gaps: bool = False) -> Column:
    """A line for each part that is not empty; with ``gaps`` for each that is not null, title and text still only if not empty."""
    part = (lambda c: c) if gaps else present
    return F.concat_ws("\n", present(title), *map(part, (topic, subtopic, summary)), *[part(F.array_join(c, " ")) for c in (keywords, concepts, tags, section_path)], present(text))


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds))
    hours = F.floor(s / 3600)
    short = F.format_string("%02d:%02d", F.floor(s % 3600 / 60), s % 60)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), short)).otherwise(short)


def minute_clock(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def iso_seconds(iso: Column) -> Column:
    """Seconds of a PT#H#M#S duration, 0 where the pattern does not occur."""
    part = lambda i: F.coalesce(F.regexp_extract(iso, DURATION, i).try_cast("long"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def duration_label(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    tail = lambda n, unit: F.when(n > 0, F.concat(F.lit(" "), n.cast("string"), F.lit(unit))).otherwise("")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), tail(m, "m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), tail(s, "s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def watch_url(video_id: Column, start: Column | None = None) -> Column:
    base = F.concat(F.lit(WATCH), video_id)
    if start is None:
        return base
    return F.when(start > 0, F.concat(base, F.lit("&t="), F.floor(start).cast("string"), F.lit("s"))).otherwise(base)


def video_link(url: Column, video: Column, seconds: Column) -> Column:
    """The address of a result's video: its own, else that of the video at these seconds, else of the video."""
    at_start = F.concat(F.lit(WATCH), video)
    return F.coalesce(url, F.when(seconds.isNotNull(), F.concat(at_start, F.lit("&t="), seconds.cast("long").cast("string"), F.lit("s"))), at_start)


def video_id(url: Column) -> Column:
    """The 11-character id of a video url of a known host, else null."""
    u = trimmed(url)
    host, path = F.lower(F.try_parse_url(u, F.lit("HOST"))), F.try_parse_url(u, F.lit("PATH"))
    ok = lambda c: F.when(c.rlike(VIDEO_ID), c)
    short = ok(F.regexp_extract(path, r"^/*([^/]*)", 1))
    long = F.coalesce(ok(F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))), present(F.regexp_extract(path, VIDEO_PATH, 1)))
    return F.when(host.isin("youtu.be", "www.youtu.be"), short).when(host.isin(*VIDEO_HOSTS), long)


def two_decimals(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def percent(score: Column) -> Column:
    return F.concat(F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100 + 0.5).cast("string"), F.lit("%"))


def highlighted(text: Column, query: str) -> Column:
    """The text with each query term between <mark> tags; longer terms first."""
    terms = sorted({t for t in query.lower().split() if len(t) >= 2}, key=lambda t: (-len(t), t))
    if not terms:
        return text
    quoted = "|".join("".join("\\" + ch if not (ch.isalnum() or ch == "_" or ord(ch) > 127) else ch for ch in t) for t in terms)
    return F.regexp_replace(text, f"(?i)({quoted})", "<mark>$1</mark>")


def file_size_label(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / (1024 * 1024)), F.lit(" MB")))
    )


def cut_text(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def summary_json(raw: Column) -> Column:
    """(summary, key_points, topics) of the outermost braces of a model's answer; anything else is the summary itself."""
    body = present(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    parsed = F.from_json(body, "summary string, keyPoints array<string>, topics array<string>")
    good = F.try_parse_json(body).isNotNull()
    none = F.array().cast("array<string>")
    strings = lambda path: F.coalesce(F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(body, path), "array<variant>"), F.array().cast("array<variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))), lambda s: s.isNotNull()), none)
    return F.struct(
        F.when(good, F.coalesce(parsed["summary"], trimmed(raw))).otherwise(trimmed(raw)).alias("summary"),
        F.when(good, strings("$.keyPoints")).otherwise(none).alias("key_points"),
        F.when(good, strings("$.topics")).otherwise(none).alias("topics"),
    )


def document_type(mime: Column) -> Column:
    return F.when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image")


def type_label(kind: Column) -> Column:
    return F.when(kind == "pdf", "PDF").when(kind == "image", "Image").when(kind == "note", "Note").when(kind == "video", "Video").otherwise(kind)
