"""Worked examples of the text functions."""

import tracemalloc
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmine.functions import query as Q
from quillmine.functions import text as T
from quillmine.operators import chunking as K
from quillmine.session import PART_BYTES
from quillmine.sources.files import safe_path


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'timestamp' if isinstance(v, datetime) else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("query", "terms"), [("React Hooks!", ["react", "hooks"]), ("a be cat", ["be", "cat"]), ("été", []), ("a-b c++ the the", ["a-b", "the", "the"])])
def test_query_tokens(spark, query, terms):
    assert Q.tokens(query) == terms
    assert one(spark, T.query_tokens(F.col("q")), q=query) == terms


def test_phrases():
    assert Q.phrases('find "React Hooks" now') == ["react hooks", 'find "react hooks" now']
    assert Q.phrases("abc") == []


@pytest.mark.parametrize(("text", "share"), [("react hooks allow state in components", 1.0), ("react components only", 0.5), (None, 0.0)])
def test_share_contained(spark, text, share):
    assert one(spark, T.share_contained(F.col("t"), ["react", "hooks"]), t=text) == share


def test_recency(spark):
    now = T.instant(datetime(2026, 6, 23))
    assert one(spark, T.recency(T.instant(datetime(2026, 6, 20)), now), t="") == pytest.approx(1 - 3 / 90)
    assert one(spark, T.recency(T.instant(datetime(2026, 1, 1)), now), t="") == 0


@pytest.mark.parametrize(("text", "n"), [("", 0), ("   ", 0), ("hello", 2), ("a" * 400, 100), (None, 0)])
def test_token_count(spark, text, n):
    assert one(spark, T.token_count(F.col("t")), t=text) == n
    assert one(spark, T.tokens_of_words(F.lit(100)), t="") == 130


def test_cleaning(spark):
    assert one(spark, T.without_extra_spaces(F.col("t")), t="Hello \t\xa0 World") == "Hello World"
    assert one(spark, T.without_repeated_newlines(F.col("t")), t="Line 1\n\n\n\nLine 2") == "Line 1\n\nLine 2"
    assert one(spark, K.clean_text(F.col("t")), t="Hello     World\n\n\nThis is    OCR ﬁ") == "Hello World\n\nThis is OCR fi"
    assert one(spark, T.sanitized(F.col("t")), t=" a\x00\x07b \n c ") == "ab c"


def test_clean_text_holds_a_portion_of_a_batch(spark):
    texts = [f"{i} \ufb01  x\u2024\n\n\n\n" * 5_000 for i in range(200)] + ["", None, " a\xa0"]
    batch, held = pa.array(texts), []
    tracemalloc.start()
    for got in K._clean_udf().func(iter([batch, batch.slice(0, 0)])):
        held += [K.clean(t) == g for t, g in zip(texts[len(held) :], got.to_pylist(), strict=False)]
        del got
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held) == len(texts) and all(held)
    assert batch.nbytes > 10 * PART_BYTES and peak < 8 * PART_BYTES
    spread = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3).select("i", "t", K.clean_text(F.col("t")).alias("x"), K.clean_text(F.upper("t")).alias("y"))
    assert sorted((r["i"], r["x"], r["y"]) for r in spread.collect() if r["t"]) == [(i, K.clean(t), K.clean(t.upper())) for i, t in enumerate(texts) if t]
    K.register(spark)
    assert spark.sql("SELECT clean_text(' a  b ') AS x, clean_text(NULL) AS y").first() == ("a b", None)


def test_preview_snippet(spark):
    long = "Introduction to programming. React Hooks allow developers to use state inside function components and share logic between many different parts"
    got = one(spark, T.preview_snippet(F.col("t"), ["react", "hooks"], 40, 80), t=long)
    assert "React Hooks" in got and len(got) <= 86 and got.endswith("...")
    assert one(spark, T.preview_snippet(F.col("t"), ["x"]), t="short text") == "short text"


@pytest.mark.parametrize(("raw", "tidy"), [("wow...?!", "wow!"), (" a  ,b\n", "a,b"), ("x​y", "xy")])
def test_transcript_text(spark, raw, tidy):
    assert one(spark, T.transcript_text(F.col("t")), t=raw) == tidy


@pytest.mark.parametrize(("s", "clock", "minutes", "label"), [(5.9, "00:05", "00:05", None), (3723.0, "01:02:03", "62:03", "1h 2m"), (-1.0, "00:00", "00:00", None), (123.0, "02:03", "02:03", "2m 3s")])
def test_clocks(spark, s, clock, minutes, label):
    assert one(spark, T.clock(F.col("s")), s=s) == clock
    assert one(spark, T.minute_clock(F.col("s")), s=s) == minutes
    if label:
        assert one(spark, T.duration_label(F.col("s").cast("long")), s=s) == label


@pytest.mark.parametrize(("iso", "s"), [("PT1H2M3S", 3723), ("PT5S", 5), ("junk", 0), ("P1DT1H", 0), ("pt2m", 120)])
def test_iso(spark, iso, s):
    assert one(spark, T.iso_seconds(F.col("t")), t=iso) == s


@pytest.mark.parametrize(
    ("url", "code"),
    [("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=3", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ?x=1", "dQw4w9WgXcQ"), ("https://m.youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://example.com/watch?v=dQw4w9WgXcQ", None), ("https://youtu.be/short", None), ("nonsense", None), (None, None)],
)
def test_video_id(spark, url, code):
    assert one(spark, T.video_id(F.col("t")), t=url) == code


def test_summary_json(spark):
    got = one(spark, T.summary_json(F.col("t")), t='Sure:\n```json\n{"summary": "s", "keyPoints": ["a", 3, "b"], "topics": "no"}\n```')
    assert (got["summary"], got["key_points"], got["topics"]) == ("s", ["a", "b"], [])
    got = one(spark, T.summary_json(F.col("t")), t="  prose {only  ")
    assert (got["summary"], got["key_points"]) == ("prose {only", [])


def test_labels(spark):
    assert one(spark, T.two_decimals(F.lit(1.005)), t="") == 1.0
    assert one(spark, T.percent(F.lit(1.7)), t="") == "100%"
    assert one(spark, T.file_size_label(F.lit(1536)), t="") == "1.5 KB"
    assert one(spark, T.highlighted(F.col("t"), "react a re"), t="React are") == "<mark>React</mark> a<mark>re</mark>"


def test_parameters():
    assert [Q.page_of(x) for x in (None, "3", "0", "x", "2abc")] == [1, 3, 1, 1, 2]
    assert [Q.limit_of(x) for x in (None, "5", "99", "-1")] == [20, 5, 50, 20]
    assert Q.type_of("pdf") == "pdf" and Q.type_of("exe") is None
    assert Q.window_of(1, 20) == 160 and Q.window_of(1, 5) == 60
    for bad in ("", "  ", "x" * 501):
        with pytest.raises(Q.RequestError):
            Q.checked_query(bad)
    with pytest.raises(Q.RequestError):
        Q.checked_question(3)
    now = datetime(2024, 1, 31, 15)
    assert Q.date_range(Q.Filter(date="7d"), now)[0] == datetime(2024, 1, 24, 15)
    assert Q.date_range(Q.Filter(date="custom", date_from="2024-01-02T03:00:00+01:00"), now)[0] == datetime(2024, 1, 2, 2)
    assert Q.date_range(Q.Filter(date="soon"), now) == (None, None)
    with pytest.raises(Q.RequestError):
        Q.date_range(Q.Filter(date="custom", date_to="nonsense"), now)


def test_safe_path(tmp_path):
    assert safe_path(str(tmp_path), "a.pdf") == str(tmp_path / "a.pdf")
    with pytest.raises(Q.RequestError):
        safe_path(str(tmp_path), "../secret.txt")
