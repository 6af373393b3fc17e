"""Adapters of services against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quillmine.sources import files
from quillmine.sources.adapters import ServiceError, extracted, tried
from quillmine.sources.services import HttpChat, HttpEmbedder, ImageText, PdfText, VideoService, checked


@pytest.fixture(scope="module")
def server():
    tries = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, said, status=200):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/busy":
                tries.append(1)
                return self.answer({}, 503) if len(tries) < 3 else self.answer({"choices": [{"message": {"content": "at last"}}]})
            if self.path == "/chat":
                return self.answer({"choices": [{"message": {"content": [{"text": body["messages"][-1]["content"]}, str(body["max_tokens"]), self.headers["Authorization"]]}}]})
            rows = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            return self.answer({"data": rows[::-1]})

        def do_GET(self):
            at, q = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if at.path == "/data":
                item = {"id": q["id"], "snippet": {"title": "Full", "channelTitle": "C", "thumbnails": {"medium": {"url": "m"}}}, "contentDetails": {"duration": "PT1M5S"}}
                return self.answer({"items": [item] if q["id"] == "aaaaaaaaaaa" else []})
            if at.path == "/embed":
                return self.answer({"title": "Plain", "author_name": "D"}) if not q["url"].endswith("ccccccccccc") else self.answer({}, 404)
            return self.answer([{"text": "hello", "offset": 0, "duration": 1500}] if q["v"] == "aaaaaaaaaaa" else [])

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_models(server):
    e = HttpEmbedder(f"{server}/vectors", "m", dimension=2)
    assert e.embed(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]]
    checked(e)
    with pytest.raises(ServiceError):
        checked(HttpEmbedder(f"{server}/vectors", "m", dimension=3))
    assert HttpChat(f"{server}/chat", "m", "secret").complete([{"role": "user", "content": "hi"}]) == [{"text": "hi"}, "1024", "Bearer secret"]
    busy = HttpChat(f"{server}/busy", "m")
    assert tried(lambda: busy.complete([]), wait_s=0.01) == "at last"


def test_videos(spark, server):
    ids = spark.createDataFrame([("aaaaaaaaaaa",), ("bbbbbbbbbbb",), ("ccccccccccc",), ("aaaaaaaaaaa",)], "video_id string")
    v = VideoService(f"{server}/data", f"{server}/embed", f"{server}/transcript", "key")
    got = {r["video_id"]: r for r in v.metadata(ids).collect()}
    assert (got["aaaaaaaaaaa"]["title"], got["aaaaaaaaaaa"]["duration_s"], got["aaaaaaaaaaa"]["thumbnail"]) == ("Full", 65, "m")
    assert (got["bbbbbbbbbbb"]["title"], got["bbbbbbbbbbb"]["duration_s"]) == ("Plain", None) and len(got) == 2
    assert {r["title"] for r in VideoService(v.data_url, v.embed_url, v.transcript_url).metadata(ids).collect()} == {"Plain"}
    (seg,) = files.transcript_segments(v.transcripts(ids)).collect()
    assert (seg["video_id"], seg["text"], seg["end_s"]) == ("aaaaaaaaaaa", "hello", 1.5)


def test_extractors_without_their_library(spark):
    rows = spark.createDataFrame([("d", "u", "t", "pdf", bytearray(b"%PDF")), ("e", "u", "t", "image", bytearray(b"x"))], "document_id string, user_id string, title string, type string, content binary")
    got = {r["type"]: r for r in extracted(rows, {"pdf": PdfText(), "image": ImageText()}).collect()}
    assert all(r["extraction_status"] == "failed" and r["extraction_error"] for r in got.values())
