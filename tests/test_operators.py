"""Worked examples and random folds of the operators."""

import math
import random
import tracemalloc
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmine.operators import chunking as K
from quillmine.operators import context, history, retrieval, tables, transcripts
from quillmine.plans import answers, indexing
from quillmine.session import PART_BYTES
from quillmine.sources import adapters, files

NOTES = """# React Notes

## Hooks
Hooks let function components use state and effects.

## Memoization
Memoization keeps results of calls between renders.

### useMemo
useMemo caches the result of a calculation between renders.

### useCallback
useCallback caches a function definition between renders of it.

## Context API
The provider shares values with all components below it, without passing props.
"""


def test_chunk_markdown():
    got = K.chunk(NOTES, "React Notes")
    assert [(c[0], c[2], c[3], c[4], c[5], c[6], c[7]) for c in got] == [
        (0, "Hooks", "Hooks", None, ["Hooks"], "topic", None),
        (1, "Memoization", "Memoization", None, ["Memoization"], "topic", None),
        (2, "useMemo", "Memoization", "useMemo", ["Memoization", "useMemo"], "subtopic", 1),
        (3, "useCallback", "Memoization", "useCallback", ["Memoization", "useCallback"], "subtopic", 1),
        (4, "Context API", "Context API", None, ["Context API"], "topic", None),
    ]
    assert got[4][1].startswith("Context API\n\nThe provider") and not got[0][1].startswith("Hooks\n\n")
    assert got[0][8] == math.ceil(len(got[0][1]) / 4)


@pytest.mark.parametrize("text", ["", "   ", None])
def test_chunk_nothing(text):
    assert K.chunk(text, "T") == []


def test_chunk_plain():
    (c,) = K.chunk("Hello world this is a test")
    assert (c[0], c[5], c[6], c[8]) == (0, ["Document"], "semantic", 7)
    assert len(K.chunk("Section A\nalpha text here is long enough to stay.\n\nSection B\nbeta text here is long enough to stay.", "Notes")) == 2


def test_split():
    text = "One sentence of words. " * 200
    parts = K.split(text, 64)
    assert all(K.tokens(p) <= 64 for p in parts) and "".join(" ".join(parts).split()) == "".join(text.split())
    assert K.split("a" * 5000, 64) == ["a" * 5000]
    assert K.split("x y\n\nz", 512) == ["x y\n\nz"]


def test_chunks_enriched_and_linked(spark):
    docs = spark.createDataFrame([(1, NOTES, "React Notes"), (2, None, None), (3, "", "x")], "document_id long, text string, title string")
    rows = {r["title"]: r for r in K.with_parents(K.enriched(K.chunked(docs))).collect()}
    memo = rows["useMemo"]
    assert "memoization" in memo["tags"] and "useMemo" in memo["summary"] and "usememo" in memo["keywords"]
    assert "Topic: Memoization\nSubtopic: useMemo" in memo["embedding_text"] and memo["concepts"][:2] == ["Memoization", "useMemo"]
    assert memo["parent_chunk_id"] == "1:1" and rows["Hooks"]["parent_chunk_id"] is None
    up = K.ancestors(K.chunked(docs)).collect()
    assert sorted((r["chunk_index"], r["ancestor"], r["distance"]) for r in up) == [(2, 1, 1), (3, 1, 1)]


def test_keywords():
    assert K.top("Cats like cats, dogs like the dogs. Cats!") == ["cats", "like", "dogs"]


def test_table_functions(spark):
    K.register(spark)
    assert spark.sql("SELECT title FROM LATERAL chunk_topics('# A\n\nalpha beta gamma delta epsilon.', 'Doc')").first()["title"] == "A"
    assert spark.sql("SELECT count(*) n FROM LATERAL split_tokens('a b')").first()["n"] == 1


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.9, 1), ("b", 0.7, 2)], "chunk_id string, score double, rank int")
    k = spark.createDataFrame([("b", 2.5, 1), ("c", 3.0, 2)], "chunk_id string, score double, rank int")
    got = {r["chunk_id"]: r for r in retrieval.fused(v, k).collect()}
    assert [got[x]["rrf_score"] for x in "bac"] == pytest.approx([0.016234796404019036, 0.009836065573770491, 0.0064516129032258064])
    assert got["a"]["vector_score"] == 0.9 and got["c"]["vector_score"] == 0.0 and got["b"]["keyword_score"] == 2.5


def test_grouping(spark):
    hits = spark.createDataFrame(
        [(i, d, "u", n, s, s, s, text, "", "", "", [], text, i, None) for i, d, n, s, text in ((1, 1, 0, 0.9, "react hooks state"), (2, 1, 1, 0.85, "react hooks lifecycle"), (3, 2, 0, 0.7, "node express server"), (4, 9, 0, 0.9, "unknown"))],
        "chunk_id long, document_id long, user_id string, chunk_index int, vector_score double, keyword_score double, rrf_score double, text string, title string, topic string, subtopic string, tags array<string>, content_preview string, vector_rank int, keyword_rank int",
    )
    docs = spark.createDataFrame([(1, "u", "React Notes", "pdf", datetime(2026, 6, 1)), (2, "u", "Node Guide", "note", datetime(2026, 5, 1))], "document_id long, user_id string, title string, type string, created_at timestamp")
    scored = retrieval.reranked(hits, ["react", "hooks"], ["react hooks"])
    assert [round(r["final_score"], 4) for r in scored.orderBy("chunk_id").collect()][:3] == [0.785, 0.7525, 0.455]
    got = retrieval.grouped(scored, docs, datetime(2026, 6, 23)).orderBy(F.desc("score")).collect()
    assert [r["document_id"] for r in got] == [1, 2] and got[0]["n_chunks"] == 2 and [m["chunk_id"] for m in got[0]["matched"]] == [1, 2]
    assert got[0]["score"] == pytest.approx(0.785 + 0.02 * 2 / 5 + 0.02 * (1 - 22 / 90))


def test_topic_and_tag(spark):
    rows = spark.createDataFrame([(1, "u", "a", ["X", "y"]), (2, "u", "b", ["z"]), (3, "v", "a", ["x"])], "chunk_id int, user_id string, topic string, tags array<string>")
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(retrieval.restricted(rows, "u", tags=["x"])) == [1]
    assert ids(retrieval.restricted(rows, topic="a")) == [1, 3] and ids(retrieval.restricted(rows)) == [1, 2, 3]


def test_budget(spark):
    rng = random.Random(3)
    for _ in range(3):
        hits = [(i, 1, i, rng.choice([0.1, 0.5, 0.9]), "w" * rng.randint(0, 400), "T", "D") for i in range(30)]
        df = spark.createDataFrame(hits, "chunk_id long, document_id long, chunk_index int, score double, text string, title string, document_title string")
        used, want = 0, []
        for h in sorted(hits, key=lambda h: (-h[3], h[0])):
            cost = math.ceil(len("[Source] D T") / 4) + (math.ceil(len(h[4]) / 4) if h[4] else 0) + 8
            if want and used + cost > 300:
                break
            want.append(h[0])
            used += cost
        assert [r["chunk_id"] for r in context.within_budget(df, 300).orderBy("place").collect()] == want


def test_context_and_answer(spark):
    hits = spark.createDataFrame([(1, 5, 0, 0.5, "alpha", "S", "D", "top", "sub", "video", 65.0, "abcdefghijk"), (2, 5, 0, 0.9, "beta", "S", "D", "top", None, None, None, None)], "chunk_id long, document_id long, chunk_index int, score double, text string, title string, document_title string, topic string, subtopic string, type string, start_s double, video_id string")
    row = context.built(hits).first()
    assert row["context"] == "[Source 1] | Document: D | Section: S | Topic: top\nbeta" and row["n_sources"] == 1
    only = hits.where("chunk_id = 1")
    assert context.built(only).first()["context"] == "[Source 1] | Type: Video | Video: D | Section: S | Topic: top | Subtopic: sub | Timestamp: 01:05\nalpha"
    cited = context.citations(context.within_budget(only)).first()
    assert cited["video_url"] == "https://www.youtube.com/watch?v=abcdefghijk&t=65s" and cited["timestamp"] == "01:05"

    class Model:
        def complete(self, messages):
            assert "beta" in messages[1]["content"]
            return " It is beta. "

    said = answers.answer(hits, "what?", Model())
    assert said.text == "It is beta." and [r["chunk_id"] for r in said.sources] == [2]
    assert answers.answer(hits.where("false"), "what?", Model()).text == answers.NO_ANSWER
    assert "1. **📺 D** · 01:05" in context.sources_markdown(context.citations(context.within_budget(only))).first()["markdown"]


def _merge(texts, most):
    out = []
    for t in texts:
        if out and len(out[-1]) + 1 + len(t) <= most:
            out[-1] = f"{out[-1]} {t}".strip()
        else:
            out.append(t)
    return out


def _pack(texts, most):
    out, buffer, n = [], [], 0
    for t in texts:
        k = math.ceil(len(t) / 4)
        if buffer and n + k > most:
            out.append(buffer)
            buffer, n = [], 0
        buffer.append(t)
        n += k
        if n >= most:
            out.append(buffer)
            buffer, n = [], 0
    return [" ".join(b) for b in [*out, *([buffer] if buffer else [])]]


def test_transcript_folds(spark):
    rng = random.Random(5)
    videos = {v: ["x" * rng.choice([1, 60, 119, 120, 240, 300, 2048, 2100]) for _ in range(rng.randint(1, 25))] for v in range(20)}
    df = spark.createDataFrame([(v, i, t, float(i), float(i + 1)) for v, ts in videos.items() for i, t in enumerate(ts)], "video_id int, i long, text string, start_s double, end_s double")
    for got, fold, order in ((transcripts.merged(df), lambda ts: _merge(ts, 240), "i"), (transcripts.packed(df), lambda ts: _pack(ts, 512), "chunk_index")):
        rows = got.orderBy("video_id", order).collect()
        assert {v: [r["text"] for r in rows if r["video_id"] == v] for v in videos} == {v: fold(ts) for v, ts in videos.items()}


def test_transcript_cleaning(spark):
    df = spark.createDataFrame([(1, 0, "Hello , world", 0.0, 1.0), (1, 1, "hello, WORLD", 1.0, 4.0), (1, 2, "  ", 4.0, 5.0), (1, 3, "bye", 5.0, 6.0)], "video_id int, i long, text string, start_s double, end_s double")
    (row,) = transcripts.cleaned(df).collect()
    assert (row["text"], row["start_s"], row["end_s"]) == ("Hello, world bye", 0.0, 6.0)
    assert transcripts.full_text(transcripts.deduplicated(transcripts.normalized(df))).first()["full_text"] == "Hello, world bye"


def test_history(spark):
    rows = [(i, 1, f"q{i % 22}", i, datetime(2024, 1, 1, 0, i)) for i in range(25)]
    h = spark.createDataFrame(rows, "event_id int, user_id int, query string, result_count int, created_at timestamp")
    got = history.saved(h.where("event_id < 24"), h.where("event_id = 24")).collect()
    assert len(got) == 20 and len({r["query"] for r in got}) == 20 and max(r["event_id"] for r in got) == 24
    assert history.without(h, 1, 3).count() == 24 and history.without(h, 2).count() == 25
    s = history.search_stats(h, datetime(2024, 1, 1, 5)).first()
    assert (s["total_searches"], s["searches_today"], s["average_results"]) == (25, 25, 12)


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 2)], "document_id int, chunk_id string, n int")
    new = spark.createDataFrame([(1, "x", 5)], t.schema)
    keys = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert keys(tables.replaced(t, new)) == ["c", "x"] and keys(tables.deleted(t, ["a", "zz"])) == ["b", "c"] and keys(tables.deleted(t, [])) == ["a", "b", "c"]
    merged = {r["chunk_id"]: r["n"] for r in tables.merged(t, spark.createDataFrame([("a", None), ("q", 4)], "chunk_id string, n int"), ["chunk_id"]).collect()}
    assert merged == {"a": None, "b": 1, "c": 2, "q": 4}
    assert keys(tables.inserted(t, spark.createDataFrame([(9, "a", 9), (9, "n", 9)], t.schema), ["chunk_id"])) == ["a", "b", "c", "n"]
    docs = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending")], "document_id int, index_status string")
    res = spark.createDataFrame([(1, None), (1, "e"), (2, "e"), (2, "f")], "document_id int, error string")
    got = {r["document_id"]: (r["index_status"], r["chunk_count"], r["index_error"]) for r in tables.with_index_state(docs, res).collect()}
    assert got == {1: ("indexed", 1, "e"), 2: ("failed", 0, "e; f"), 3: ("pending", 0, None)}


def test_indexing(spark):
    docs = spark.createDataFrame([(1, NOTES, "React Notes", None), (2, None, "Film", "v1")], "document_id long, extracted_text string, title string, video_id string")
    seg = spark.createDataFrame([("v1", 0, "hello there", 0.0, 2.0)], "video_id string, i long, text string, start_s double, end_s double")
    made = indexing.indexed(docs, adapters.HashEmbedder(16), seg)
    rows = made.collect()
    assert len(rows) == 6 and all(len(r["vector"]) == 16 and r["error"] is None for r in rows)
    assert [r["topic"] for r in rows if r["document_id"] == 2] == ["Film"]
    store, state = indexing.reindexed(made.drop("error"), docs.select("document_id", F.lit("pending").alias("index_status")), made)
    assert store.count() == 6 and {r["index_status"] for r in state.collect()} == {"indexed"}


def test_adapters(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("503")
        return 7

    assert adapters.tried(flaky, wait_s=0) == 7
    assert adapters.service_error("429 Too many").status == 429 and adapters.service_error("boom").status == 500
    bad = adapters.embedded(spark.createDataFrame([("a", "  "), ("b", "x")], "id string, embedding_text string"), adapters.HashEmbedder(4)).collect()
    assert [(r["error"], r["vector"] is None) for r in sorted(bad)] == [("Text is empty", True), (None, False)]
    rows = spark.createDataFrame([("note", bytearray(b" hi ")), ("note", bytearray(b" ")), ("exe", bytearray(b"x"))], "type string, content binary")
    got = [(r["extraction_status"], r["extracted_text"]) for r in adapters.extracted(rows, {"note": adapters.PlainText()}).collect()]
    assert sorted(got, key=str) == [("completed", "hi"), ("failed", None), ("failed", None)]


def test_extraction_holds_a_portion_of_a_batch(spark):
    class Seen:
        sparkSession, schema = spark, spark.createDataFrame([], "k long, type string, at timestamp, content binary, extracted_text string").schema

        def mapInArrow(self, run, schema):
            return run

    texts = [f" {i} text\n" * 10_000 for i in range(200)]
    content = [*(t.encode() for t in texts), None, b"\xff", b" ", b"x"]
    n = len(content)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["note"] * (n - 1) + [None]), pa.array([datetime(2024, 1, 31)] * n), pa.array(content), pa.nulls(n, pa.string())], ["k", "type", "at", "content", "extracted_text"])
    run, seen = adapters.extracted(Seen(), {"note": adapters.PlainText()}), []
    tracemalloc.start()
    for got in run(iter([batch, batch.slice(0, 0)])):
        assert got.schema.names == ["k", "type", "at", "extracted_text", "extraction_error", "extraction_status"]
        for r in got.select(["k", "extracted_text", "extraction_error", "extraction_status"]).to_pylist():
            k = r["k"]
            assert k == len(seen)
            seen.append((r["extraction_status"], r["extraction_error"]) if k >= len(texts) else r["extracted_text"] == texts[k].strip())
        del got, r
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen[: len(texts)] == [True] * len(texts)
    assert [s for s, _ in seen[len(texts) :]] == ["failed"] * 4 and all(e for _, e in seen[len(texts) :]) and len(seen) == n
    assert batch.nbytes > 10 * PART_BYTES and peak < 8 * PART_BYTES


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"no")
    (row,) = files.uploads(spark, str(tmp_path), "u").collect()
    assert (row["title"], row["type"], row["file_size"]) == ("a.PDF", "pdf", 4)
    notes = files.notes(spark.createDataFrame([("u", " t ", " c "), ("u", "", "c"), ("u", "t" * 201, "c")], "user_id string, title string, content string")).collect()
    assert [(n["title"], n["extracted_text"]) for n in notes] == [("t", "c")]
    api = files.video_metadata(spark.createDataFrame([('{"items":[{"id":"v","snippet":{"title":"T","thumbnails":{"medium":{"url":"m"}}},"contentDetails":{"duration":"PT2M"}}]}',), ("{}",)], "payload string"))
    embed = files.embed_metadata(spark.createDataFrame([("v", "{}"), ("w", '{"title":"W"}')], "video_id string, payload string"))
    got = {r["video_id"]: (r["title"], r["channel"], r["thumbnail"], r["duration_s"]) for r in files.metadata_with_fallback(api, embed).collect()}
    assert got == {"v": ("T", "Unknown Channel", "m", 120), "w": ("W", "Unknown Channel", "", None)}
    seg = files.transcript_segments(spark.createDataFrame([("v", [("a", 1000.0, 500.0)]), ("w", [])], "video_id string, segments array<struct<text:string,offset:double,duration:double>>")).collect()
    assert [(s["video_id"], s["start_s"], s["end_s"]) for s in seg] == [("v", 1.0, 1.5)]
