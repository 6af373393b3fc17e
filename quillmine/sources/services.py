"""Services behind HTTP, and file extractors that need a library of their own. Addresses and keys are parameters."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.functions import text as T
from quillmine.session import ship
from quillmine.sources import files
from quillmine.sources.adapters import DIMENSION, GAP_S, TIMEOUT_S, service_error, tried

#: Seconds that metadata and a transcript may take, and a chat model's freedom and longest answer.
METADATA_S, TRANSCRIPT_S, TEMPERATURE, MOST_ANSWER = 15.0, 30.0, 0.2, 1024


def sent(url: str, body: dict | None = None, key: str | None = None, timeout_s: float = TIMEOUT_S) -> str:
    """The answer to a GET, or to a POST of JSON; an error's message has its HTTP status."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urlopen(Request(url, None if body is None else json.dumps(body).encode(), head), timeout=timeout_s) as r:
            return r.read().decode("utf-8")
    except HTTPError as e:
        raise RuntimeError(f"{e.code} {e.reason}") from e


@dataclass
class HttpEmbedder:
    """An embedder that takes {model, input} and answers {data: [{index, embedding}]}."""

    url: str
    model: str
    key: str | None = None
    dimension: int = DIMENSION
    gap_s: float = GAP_S

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        said = json.loads(sent(self.url, {"model": self.model, "input": list(texts)}, self.key))
        rows = sorted(said["data"], key=lambda x: x.get("index", 0))
        return [x["embedding"] for x in rows]


@dataclass
class HttpChat:
    """A chat model that takes {model, messages, temperature, max_tokens} and answers {choices: [{message: {content}}]}."""

    url: str
    model: str
    key: str | None = None
    temperature: float = TEMPERATURE
    most_tokens: int = MOST_ANSWER

    def complete(self, messages: Sequence[dict[str, str]]) -> object:
        said = json.loads(sent(self.url, {"model": self.model, "messages": list(messages), "temperature": self.temperature, "max_tokens": self.most_tokens}, self.key))
        return said["choices"][0]["message"]["content"]


def checked(embedder) -> None:
    """Fail if an embedder's vectors have another size than it says."""
    got = len(embedder.embed(["size"])[0])
    if got != embedder.dimension:
        raise service_error(f"expected dimension {embedder.dimension}, got {got}")


def fetched(videos: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """(video_id, payload, error) of each video: what ``get`` answers, tried again if its failure may pass."""
    ship(videos.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v in f["video_id"]:
                try:
                    out.append((v, tried(lambda v=v: get(v)), None))
                except Exception as e:
                    out.append((v, None, str(e)))
            yield pd.DataFrame(out, columns=["video_id", "payload", "error"])

    return videos.select("video_id").distinct().mapInPandas(run, "video_id string, payload string, error string")


@dataclass
class VideoService:
    """Metadata and transcripts of videos by HTTP: a data interface with a key, else the embedding one, which has no duration."""

    data_url: str
    embed_url: str
    transcript_url: str
    key: str | None = None

    def metadata(self, videos: DataFrame) -> DataFrame:
        """(video_id, title, channel, thumbnail, duration_s); videos that neither interface knows are left out."""
        page, embed_url, data_url, key = T.WATCH, self.embed_url, self.data_url, self.key
        plain = files.embed_metadata(fetched(videos, lambda v: sent(f"{embed_url}?{urlencode({'url': page + v, 'format': 'json'})}", timeout_s=METADATA_S)).where("payload is not null"))
        if not key:
            return plain
        full = fetched(videos, lambda v: sent(f"{data_url}?{urlencode({'part': 'snippet,contentDetails', 'id': v, 'key': key})}", timeout_s=METADATA_S))
        return files.metadata_with_fallback(files.video_metadata(full.where("payload is not null")), plain)

    def transcripts(self, videos: DataFrame, lang: str | None = None) -> DataFrame:
        """(video_id, segments) for ``files.transcript_segments``, from a JSON list of {text, offset, duration} in milliseconds."""
        url = self.transcript_url
        got = fetched(videos, lambda v: sent(f"{url}?{urlencode({'v': v} | ({'lang': lang} if lang else {}))}", timeout_s=TRANSCRIPT_S))
        kind = "array<struct<text:string,offset:double,duration:double>>"
        return got.select("video_id", F.coalesce(F.from_json("payload", kind), F.array().cast(kind)).alias("segments"))


class PdfText:
    """Text of PDF files, by pypdf where it is installed."""

    def extract(self, content: bytes) -> str:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("PDF files need the library pypdf") from e
        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


class ImageText:
    """Text of images, by pytesseract where it is installed."""

    def __init__(self, lang: str = "eng"):
        self.lang = lang

    def extract(self, content: bytes) -> str:
        try:
            import pytesseract
            from PIL import Image
        except ImportError as e:
            raise RuntimeError("Images need the libraries pytesseract and Pillow") from e
        return pytesseract.image_to_string(Image.open(io.BytesIO(content)), lang=self.lang)
