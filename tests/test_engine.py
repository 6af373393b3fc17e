"""The requests of the service, from notes to answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmine.engine import Engine
from quillmine.functions import text as T
from quillmine.functions.query import Filter, RequestError, query_string
from quillmine.operators import chunking as K
from quillmine.operators import retrieval
from quillmine.plans.answers import NO_ANSWER, content_text
from quillmine.plans.indexing import vector_metadata
from quillmine.sources.adapters import HashEmbedder, PlainText
from quillmine.sources.store import Store
from quillmine.sources.vectors import TableVectors

NOW = datetime(2024, 5, 1, 12)


class Model:
    asked = 0

    def complete(self, messages):
        Model.asked += 1
        return '{"summary": "short", "keyPoints": ["a"], "topics": []}' if "JSON" in messages[0]["content"] else "Because."


def test_requests(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), HashEmbedder(32), Model(), {"note": PlainText(), "pdf": PlainText()}, "tenant")
    notes = [("u", "React", "# Hooks\n\nreact hooks keep state in function components of react."), ("u", "Cooking", "# Soup\n\nboil water and add salt, herbs and carrots to the soup."), ("v", "Other", "react hooks belong to somebody else in this note.")]
    e.create_notes(spark.createDataFrame(notes, "user_id string, title string, content string"), NOW)
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"Plain text of a file about gardens and the flowers that grow there.")
    (tmp_path / "up" / "b.png").write_bytes(b"x")
    e.upload(str(tmp_path / "up"), "u", NOW + timedelta(hours=1))
    docs = {r["title"]: r for r in e.documents("u").collect()}
    assert set(docs) == {"React", "Cooking", "a.pdf", "b.png"}
    assert docs["React"]["index_status"] == "indexed" and docs["b.png"]["extraction_status"] == "failed" and docs["b.png"]["index_status"] == "pending"
    assert list(e.documents("u").collect())[0]["created_at"] == NOW + timedelta(hours=1)

    found = e.search("u", "react hooks", NOW)
    assert found[0]["title"] == "React" and all(r["title"] != "Other" for r in found)
    assert [r["title"] for r in e.search("u", "soup", NOW, f=Filter(type="pdf"))] in ([], ["a.pdf"])
    assert e.search("u", "react hooks", NOW + timedelta(minutes=1))[0]["title"] == "React"
    recent = e.recent_searches("u").collect()
    assert [r["query"] for r in recent] == ["react hooks", "soup"]
    assert e.search_stats("u", NOW)["total_searches"] == 2
    assert e.forget("u", recent[1]["event_id"]) == 1 and e.forget("u") == 1
    with pytest.raises(RequestError):
        e.forget("u", 99)

    said = e.ask("u", "react hooks keep state in components?")
    assert said.text == "Because." and said.sources[0]["document_name"] == "React"
    assert e.ask("nobody", "react?").text == NO_ANSWER
    react = docs["React"]["document_id"]
    before = Model.asked
    assert e.summary("u", react)["key_points"] == ["a"] == e.summary("u", react)["key_points"] and Model.asked == before + 1
    e.forget_summary(react)
    assert e.summary("u", react)["summary"] == "short" and Model.asked == before + 2
    assert e.index_status("u", react) == {"index_status": "indexed", "index_error": None, "chunk_count": 1}
    e.reprocess("u", react, NOW)
    assert e.chunks("u", react).count() == 1 and e.document_stats("u")["total"] == 4
    e.reprocess("u", react, NOW + timedelta(days=1))
    assert e.summary("u", react)["summary"] == "short" and Model.asked == before + 3  # the document has changed
    with pytest.raises(RequestError) as no:
        e.document("v", react)
    assert no.value.status == 403
    e.delete_document("u", react)
    with pytest.raises(RequestError):
        e.document("u", react)
    assert all(r["title"] != "React" for r in e.search("u", "react hooks", NOW))


def test_states_and_history(spark, tmp_path):
    class Counting(HashEmbedder):  # local, so that it travels to the workers
        def __init__(self, folder):
            HashEmbedder.__init__(self, 8)
            self.folder = folder

        def embed(self, texts):
            import uuid

            for t in texts:
                (self.folder / str(uuid.uuid4())).write_text(t)
            return HashEmbedder.embed(self, texts)

    (tmp_path / "seen").mkdir()
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b" ")
    e = Engine(spark, str(tmp_path / "store"), Counting(tmp_path / "seen"), None, {"pdf": PlainText()})
    e.upload(str(tmp_path / "up"), "u", NOW)
    e.create_notes(spark.createDataFrame([("u", "One", "a note about the weather in the mountains.")], "user_id string, title string, content string"), NOW)
    assert len(list((tmp_path / "seen").iterdir())) == 1  # each text is embedded once
    pdf = e.documents("u").where("title = 'a.pdf'").first()
    assert (pdf["extraction_status"], e.index_status("u", pdf["document_id"])["index_status"]) == ("failed", "pending")
    e.reprocess("u", pdf["document_id"], NOW).result()
    assert e.wait_indexed("u", pdf["document_id"], 1) == "failed" and e.index_status("u", pdf["document_id"])["index_error"] == "No extractable text"
    (tmp_path / "up" / "a.pdf").write_bytes(b"At last there is a text about rivers in this file.")
    e.queued_reindex("u", pdf["document_id"], NOW).result()
    assert e.wait_indexed("u", pdf["document_id"]) == "indexed" and e.chunks("u", pdf["document_id"]).count() == 1
    for i in range(3):
        e.search("u", "weather", NOW + timedelta(minutes=i))
    assert e.search("u", "rivers", NOW, f=Filter(type="video")) == []
    assert e.store.read("history").count() == 4 and e.recent_searches("u").count() == 2
    e.compact_history()
    assert e.store.read("history").count() == 2 and e.recent_searches("u").first()["created_at"] == NOW + timedelta(minutes=2)


def test_calls_are_tried_and_timed():
    import time

    from quillmine.sources.adapters import ServiceError, service_error, timed, tried

    with pytest.raises(TimeoutError):
        timed(lambda: time.sleep(5), 0.05)
    said = []

    def call(message):
        said.append(1)
        raise RuntimeError(message)

    for message, times in (("503 unavailable", 3), ("bad request", 1)):
        said.clear()
        with pytest.raises(RuntimeError):
            tried(lambda m=message: call(m), wait_s=0.01)
        assert len(said) == times
    assert isinstance(service_error("timed out after 60 s"), ServiceError) and service_error("timed out after 60 s").status == 504


def test_video(spark, tmp_path):
    e = Engine(spark, str(tmp_path), HashEmbedder(16))
    meta = spark.createDataFrame([("abcdefghijk", "Film", "Channel", "", None)], "video_id string, title string, channel string, thumbnail string, duration_s long")
    raw = spark.createDataFrame([("abcdefghijk", [("hello there", 0.0, 1500.0), ("general words", 1500.0, 900.0)])], "video_id string, segments array<struct<text:string,offset:double,duration:double>>")
    key = e.import_video("u", "https://youtu.be/abcdefghijk", meta, raw, NOW)
    assert e.import_video("u", "https://youtu.be/abcdefghijk", meta, raw, NOW) == key
    video = e.store.read("videos").first()
    assert (video["status"], video["duration_s"]) == ("indexed", 3)
    (chunk,) = e.chunks("u", key).collect()
    assert (chunk["title"], chunk["topic"], chunk["text"]) == ("00:00 - 00:02", "Film", "hello there general words")
    (found,) = e.search("u", "general words", NOW)
    assert (found["timestamp"], found["video_url"], found["section_path"]) == ("00:00", "https://www.youtube.com/watch?v=abcdefghijk", ["Film", "00:00"])
    kept = vector_metadata(e.store.read("chunks")).first()
    assert (kept["source_type"], kept["subtopic"]) == ("video", "00:00") and "text" not in kept.asDict()
    with pytest.raises(RequestError):
        e.import_video("u", "https://example.com/abcdefghijk", meta, raw, NOW)


def test_small_parts(spark):
    assert content_text(["a", {"text": "b"}]) == "ab" and content_text(None) == ""
    hits = spark.createDataFrame([(1, 0.5), (2, 0.9)], "chunk_id long, score double")
    assert [(r["chunk_id"], r["rrf_score"], r["vector_rank"]) for r in retrieval.vector_only(hits).orderBy("vector_rank").collect()] == [(2, 0.9, 1), (1, 0.5, 2)]
    vectors = spark.createDataFrame([([1.0, 2.0],)], "vector array<double>")
    assert retrieval.of_dimension(vectors, 2).count() == 1
    with pytest.raises(Exception, match="expected dimension 3"):
        retrieval.of_dimension(vectors, 3).collect()


def test_vector_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), {"chunks": "chunk_id string, document_id string, user_id string, text string, topic string, tags array<string>, vector array<double>"})
    v = TableVectors(s)
    rows = [("1", "d", "u", "red apples", "fruit", ["A"], [1.0, 0.0]), ("2", "d", "u", "green pears", "fruit", [], [0.0, 1.0]), ("3", "e", "v", "red apples", "fruit", ["a"], [1.0, 0.0])]
    v.put(spark.createDataFrame(rows, s.read("chunks").schema))
    ids = lambda df: [r["chunk_id"] for r in df.collect()]
    assert ids(v.near([1.0, 0.2], "u", 5)) == ["1", "2"] and ids(v.near([1.0, 0.2], "u", 5, 0.5)) == ["1"] and ids(v.near([1.0, 0.2], "u", 5, tags=["a"])) == ["1"]
    assert ids(v.matching(["red"], "u", 5)) == ["1"]
    v.update(spark.createDataFrame([("2", [1.0, 0.1]), ("9", [1.0, 1.0])], "chunk_id string, vector array<double>"))
    assert ids(v.near([1.0, 0.1], "u", 1)) == ["2"] and s.read("chunks").count() == 3
    v.delete(["2", "3", "none"], "u")
    assert sorted(ids(s.read("chunks"))) == ["1", "3"]
    v.delete_document("d", "u")
    assert ids(s.read("chunks")) == ["3"]


def test_addresses(spark):
    assert query_string("a b&c", 2, None, Filter(type="pdf", date="7d", topic="x")) == "q=a+b%26c&page=2&type=pdf&date=7d"
    rows = spark.createDataFrame([("own", "v", 3.0), (None, "v", 3.9), (None, "v", None), (None, None, 1.0)], "url string, video string, s double")
    got = [r[0] for r in rows.select(T.video_link(F.col("url"), F.col("video"), F.col("s"))).collect()]
    assert got == ["own", "https://www.youtube.com/watch?v=v&t=3s", "https://www.youtube.com/watch?v=v", None]
    assert [K.is_list_line(x) for x in ("- a", " * b", "• c", "1. d", "2) e", "f", "-g")] == [True] * 5 + [False] * 2
