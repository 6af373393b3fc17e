"""Operator 9: language ID by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from quillmine.llm.bpe import slices
from quillmine.llm.common import cut, ship
from quillmine.llm.totals import total

#: Hashed n-grams of 1 to LONGEST characters, characters of a text that are counted at a time.
BITS, LONGEST, PIECE = 15, 3, 1 << 20
SIZE = 1 << BITS
#: The bound of the labelled sample: rows a language (in the mean), and bytes of all their n-gram counts; hashes run below SPAN.
FIT_ROWS, FIT_BYTES, SPAN = 1500, 300_000_000, 1 << 30
#: Languages up to which the sample's bounds are broadcast.
FEW_LANGS = 10_000
#: FTRL: learning rate, smoothing, elastic-net penalties, rounds over the sample.
ALPHA, BETA, L1, L2, ROUNDS = 0.3, 1.0, 0.02, 0.05, 3
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the lower-cased text occurs; runs of ASCII non-letters count as one space."""
    out = np.zeros(SIZE, np.int64)
    for at in range(0, max(1, len(text)), PIECE):  # pieces overlap so that each n-gram falls into one of them
        c = np.frombuffer((" " + text[at : at + PIECE].lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((c < 128) & ((c < 97) | (c > 122)), np.uint32(32), c)
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        h = np.zeros(len(c), np.uint32)
        for n in range(LONGEST):
            if len(c) <= n:
                break
            h = (h[: len(c) - n] ^ c[n:]) * _MULTIPLIERS[n]
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), minlength=SIZE)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # n-grams x languages, most of them zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if self.langs:
            for k in range(0, len(some), 64):
                part = some[k : k + 64]
                z = self.logits(np.stack([vector(counts(texts[i]), self.idf) for i in part])) / self.temperature
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, row in zip(part, p, strict=True):
                    out[i] = self.langs[int(row.argmax())], float(row.max())
        return out


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf).astype(np.float32) * idf
    return x / max(1e-9, float(np.sqrt((x * x).sum())))


def train(rows: Sequence[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL-proximal over (language, n-gram numbers, their counts); every fifth row is kept to fit the temperature."""
    langs = sorted({r[0] for r in rows})
    z, n = np.zeros((SIZE, len(langs))), np.zeros((SIZE, len(langs)))
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))

    def weight(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def features(r: tuple) -> tuple[np.ndarray, np.ndarray]:
        x = np.log1p(r[2]) * idf[r[1]]
        return r[1], x / max(1e-9, float(np.sqrt((x * x).sum())))

    learn = [r for i, r in enumerate(rows) if i % 5] or list(rows)
    for _ in range(ROUNDS):
        for r in learn:
            i, x = features(r)
            w, b = weight(z[i], n[i]), weight(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            g = p / p.sum()
            g[langs.index(r[0])] -= 1
            for at, grad, zz, nn, ww in ((i, x[:, None] * g, z, n, w), (slice(None), g, zb, nb, b)):
                more = nn[at] + grad * grad
                zz[at] += grad - (np.sqrt(more) - np.sqrt(nn[at])) / ALPHA * ww
                nn[at] = more
    model = Model(langs, idf, weight(z, n).astype(np.float32), weight(zb, nb, 0.0).astype(np.float32))
    kept = [r for i, r in enumerate(rows) if not i % 5]
    if kept:
        s = np.stack([(lambda ix: ix[1] @ model.weights[ix[0]] + model.bias)(features(r)) for r in kept])
        y = np.array([langs.index(r[0]) for r in kept])

        def loss(t: float) -> float:
            q = s / t
            return float((np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1)) + q.max(axis=1) - q[np.arange(len(y)), y]).mean())

        model.temperature = min((10 ** (e / 20) for e in range(-40, 41)), key=loss)
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> Model:
    """Learn from a table of texts with known language.

    The document frequencies of all its n-grams are counted. Weights and temperature are fitted on about FIT_ROWS rows
    of each language, those of the smallest hashes of ``order``; the driver gets their n-gram counts one task's at a time, at
    most 196 kB a row however long its text, and stops at FIT_BYTES of them, in the order of the hash. Languages have no
    limit; each adds 512 kB to the driver and 128 kB to the model.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        df = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                if has_letter(t):
                    df[:-1] += counts(t) > 0
                    df[-1] += 1
        return df if df[-1] else None

    df = total(known.select(text), frequencies, SIZE + 1)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    h = F.xxhash64(order)
    share = F.least(F.lit(1.0), F.lit(float(FIT_ROWS)) / F.col("count"))
    bounds = cut(known.groupBy(F.col(lang).alias("fit_lang")).count().select("fit_lang", (F.lit(float(SPAN)) * share).cast("long").alias("bound")))
    bounds = F.broadcast(bounds) if bounds.count() <= FEW_LANGS else bounds
    rows = known.where(F.col(order).isNotNull()).select(order, lang, text).join(bounds, F.col(lang) == F.col("fit_lang")).where(F.pmod(h, F.lit(SPAN)) < F.col("bound"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(k.as_py(), g.as_py(), counts(t.as_py())) for k, g, t in zip(*batch.columns, strict=True) if has_letter(t.as_py())]
            at = [np.flatnonzero(c) for *_, c in kept]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.string()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([k[2][a].astype("<u4").tobytes() for k, a in zip(kept, at, strict=True)], pa.binary())], ["h", "lang", "at", "n"])

    counted = rows.select(h.alias("h"), F.col(lang).cast("string"), text).mapInArrow(features, "h long, lang string, at binary, n binary")
    got, size = [], 0
    for r in counted.orderBy("h", "lang", "at", "n").toLocalIterator():
        size += len(r["at"]) + len(r["n"])
        if size > FIT_BYTES:
            break
        got.append(r)
    return train([(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")) for r in got], idf)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``lang_pred`` and ``lang_score`` (the calibrated probability).

    Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
    learned; of equal probabilities the first language in order counts; repeated rows are predicted each. The
    model is broadcast: 128 kB a language. No shuffle.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    at, names = docs.columns.index(text), [*docs.columns, "lang_pred", "lang_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, end, texts in slices(batch.column(at)):
                found = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, end - i).columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()))
