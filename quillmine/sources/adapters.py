"""Interfaces of services outside Spark, with stand-ins that need none."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillmine.session import portions, ship

V = TypeVar("V")
#: Tries of a call, seconds that the wait grows by, that a call may take, and between batches; texts of a batch, size of a vector.
TRIES, WAIT_S, TIMEOUT_S, GAP_S, BATCH, DIMENSION = 3, 1.0, 60.0, 0.15, 16, 1024
#: What the messages of failures that may pass have in them.
PASSING = ("rate limit", "429", "502", "503", "timeout", "timed out", "econnreset")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class ChatModel(Protocol):
    def complete(self, messages: Sequence[dict[str, str]]) -> str: ...


class Extractor(Protocol):
    def extract(self, content: bytes) -> str: ...


class ServiceError(RuntimeError):
    """A failed call; ``status`` is the HTTP status that it maps to."""

    def __init__(self, message: str, status: int):
        super().__init__(message)
        self.status = status


def service_error(message: str) -> ServiceError:
    """Map a service's message to a status by what it mentions."""
    low = message.lower()
    for status, marks in ((429, ("429", "rate limit")), (504, ("timeout", "timed out")), (503, ("503", "unavailable")), (502, ("401", "403", "api key", "unauthorized", "502"))):
        if any(m in low for m in marks):
            return ServiceError(message, status)
    return ServiceError(message, 500)


def passing(e: Exception) -> bool:
    """Whether a failure may pass by itself, so that another try is worth it."""
    return isinstance(e, TimeoutError) or any(m in str(e).lower() for m in PASSING)


def timed(call: Callable[[], V], timeout_s: float) -> V:
    """The call's result, or TimeoutError after so many seconds; the call itself is left to end in its thread."""
    got: list = []

    def run() -> None:
        try:
            got.append((call(), None))
        except BaseException as e:
            got.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(timeout_s)
    if not got:
        raise TimeoutError(f"timed out after {timeout_s:g} s")
    value, error = got[0]
    if error is not None:
        raise error
    return value


def tried(call: Callable[[], V], tries: int = TRIES, wait_s: float = WAIT_S, retry: Callable[[Exception], bool] = passing, timeout_s: float = TIMEOUT_S) -> V:
    """The call's result; failures that may pass are tried again after a wait that grows by ``wait_s`` each time."""
    for n in range(1, tries + 1):
        try:
            return timed(call, timeout_s)
        except Exception as e:
            if n == tries or not retry(e):
                raise
            time.sleep(wait_s * n)
    raise AssertionError("unreachable")


class HashEmbedder:
    """A deterministic embedder of hashed words, of unit length; for tests and offline use, so batches need no gap."""

    gap_s = 0.0

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w.encode())
                v[h % self.dimension] += 1 if h >> 63 else -1
            norm = float(np.linalg.norm(v)) or 1.0
            out.append((v / norm).tolist())
        return out


class PlainText:
    """An extractor for files that are text."""

    def extract(self, content: bytes) -> str:
        return content.decode("utf-8")


def embedded(rows: DataFrame, embedder: Embedder, text: str = "embedding_text", batch: int = BATCH) -> DataFrame:
    """Rows with ``vector`` and ``error``: batches in order, blank texts and wrong dimensions are errors of their row or batch.

    A task waits between its batches, GAP_S seconds unless the embedder names its own ``gap_s``.
    """
    ship(rows.sparkSession)
    gap = getattr(embedder, "gap_s", GAP_S)
    names = [*rows.columns, "vector", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        called = False
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].copy()
                good = part[text].fillna("").str.strip() != ""
                vectors, errors = [None] * len(part), ["Text is empty"] * len(part)
                places = np.flatnonzero(good.to_numpy())
                if len(places):
                    if called:
                        time.sleep(gap)
                    called = True
                    try:
                        made = tried(lambda t=part[text].iloc[places].str.strip().tolist(): embedder.embed(t))
                        if len(made) != len(places) or any(len(v) != embedder.dimension for v in made):
                            raise ValueError(f"expected {len(places)} vectors of {embedder.dimension}")
                        for p, v in zip(places, made, strict=True):
                            vectors[p], errors[p] = [float(x) for x in v], None
                    except Exception as e:
                        for p in places:
                            errors[p] = str(e)
                part["vector"], part["error"] = vectors, errors
                yield part[names]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, vector array<double>, error string")


def extracted(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """Files (type, content, ...) with ``extraction`` (success, text, error); a failure is a value, not an exception.

    Contents of about PART_BYTES, or one file, are read and given back at a time.
    """
    ship(files.sparkSession)
    keep = [f for f in files.schema.fields if f.name not in ("content", "extraction_status", "extracted_text", "extraction_error")]
    names = [f.name for f in keep]

    def read(kind: str | None, content: bytes | None) -> tuple[str | None, str | None]:
        """The text, or the error."""
        try:
            if kind not in extractors:
                raise ValueError(f"Unsupported document type: {kind}")
            t = extractors[kind].extract(bytes(content)).strip()
            if not t:
                raise ValueError("No extractable text")
            return t, None
        except Exception as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in portions(batch.column("content")):
                part = batch.slice(at, end - at)
                got = [read(kind.as_py(), content.as_py()) for kind, content in zip(part.column("type"), part.column("content"), strict=True)]
                texts, errors = ([x[i] for x in got] for i in (0, 1))
                made = [texts, errors, ["failed" if e else "completed" for e in errors]]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(x, pa.string()) for x in made)], [*names, "extracted_text", "extraction_error", "extraction_status"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return files.mapInArrow(run, f"{fields}, extracted_text string, extraction_error string, extraction_status string")
