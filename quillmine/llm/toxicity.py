"""Operator 4: toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quillmine.llm.bpe import slices
from quillmine.llm.common import give_back, ship

#: Words of a window; bytes of ordinary text that both dictionaries hold and of the trained part in which they differ.
WINDOW, SHARED, OWN = 8, 4_000_000, 16_000
#: Toxic text is sampled by windows of SHORT words that the toxic text of the other FOLDS - 1 folds compresses better by LEAST
#: bytes than ordinary text does, in ROUNDS rounds; each fold's dictionary is MOST bytes at most.
SHORT, FOLDS, LEAST, ROUNDS, MOST = 4, 5, 2, 2, 2_000_000
#: Bytes of a segment that dictionary training chooses, of the strings that it counts, and of samples for a byte of dictionary.
SEGMENT, COUNTED, DENSE = 32, 8, 10
#: Gains of a window are counted from LOW to HIGH bytes.
LOW, HIGH = -8, 15
#: The bound of the labelled sample: rows, and characters of their texts.
FIT_ROWS, FIT_CHARS = 16_000, 60_000_000
_STRIP = ".,!?;:\"()|"


def tokens(text: str | None) -> list[str]:
    return [x for x in (w.strip(_STRIP) for w in (text or "").lower().split()) if x]


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = tokens(text)
    return [f" {' '.join(words[i : i + size])} ".encode("utf-8", "surrogatepass") for i in range(0, max(1, len(words)), size)]


@dataclass
class Model:
    """The dictionaries, the log-likelihood ratio of each gain, and a logistic curve over a document's features."""

    ordinary: bytes
    toxic: bytes
    ratio: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def gains(self, text: str | None) -> np.ndarray:
        """For each window, by how many bytes the toxic dictionary compresses it better than the ordinary one."""
        if not hasattr(self, "_pair"):
            self._pair = _compressor(self.ordinary), _compressor(self.toxic)
        a, b = self._pair[0].compress, self._pair[1].compress
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)]).clip(LOW, HIGH)

    def features(self, gains: np.ndarray) -> np.ndarray:
        r = np.sort(self.ratio[gains - LOW])
        return np.array([r.sum(), r[-1], math.log(len(r)), r[-3:].sum(), (gains >= 3).sum() / (8 + len(gains))])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = float(((self.features(self.gains(text)) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(window_log=22, hash_log=22, chain_log=21, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def _compressor_dict(content: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=parameters())
    return d


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(dict_data=_compressor_dict(content), compression_params=parameters())


def _gain(ordinary: bytes, toxic: bytes) -> Callable[[bytes], int]:
    a, b = _compressor(ordinary).compress, _compressor(toxic).compress
    return lambda w: len(a(w)) - len(b(w))


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def telling(toxic: list[str], shared: bytes, rest: bytes) -> list[bytes]:
    """The windows of toxic texts that the toxic texts of other folds compress better than as much ordinary text does.

    What toxic texts have in common with each other but not with ordinary text remains; chance likeness does not, as a
    window never meets its own text. Later rounds compare with the windows that the round before has left.
    """
    folds = [toxic[i::FOLDS] for i in range(FOLDS)]
    cuts = [[w for t in fold for w in windows(t, SHORT)] for fold in folds]
    left = [[w for t in fold for w in windows(t)] for fold in folds]
    for _ in range(ROUNDS):
        chosen = []
        for k, fold in enumerate(cuts):
            own = b"".join(w for i, ws in enumerate(left) if i != k for w in ws)[:MOST]
            gain = _gain(rest[: len(own)] + shared, own + shared)
            chosen.append([w for w in fold if gain(w) >= LEAST])
            del gain  # some 70 MB, before the next
        left = chosen
    return [w for ws in left for w in ws]


def fit(rows: Sequence[tuple[str | None, int]]) -> Model:
    """Train on (text, 0 or 1): four fifths of the rows train the dictionaries, the others calibrate.

    One dictionary is trained on windows of ordinary text, the other on the telling windows of toxic text (see above), as
    most words of a toxic text are ordinary. Behind their trained part both hold the same ordinary text, so that a gain
    comes from toxic wording alone. If either label is missing, the score is the share of label 1 (0 without rows).
    """
    content = [r for i, r in enumerate(rows) if i % 5 < 4]
    calibration = [r for i, r in enumerate(rows) if i % 5 == 4]
    share = sum(y for _, y in rows) / len(rows) if rows else 0.0
    empty = np.zeros(0)
    if any(len({y for _, y in part}) < 2 for part in (content, calibration)):
        return Model(b"", b"", empty, empty, empty, empty, share)
    ordinary: list[bytes] = []
    size = 0
    for text, y in content:
        if not y and size < SHARED + MOST:
            more = windows(text)
            ordinary += more
            size += sum(map(len, more))
    toxic = [text or "" for text, y in content if y]
    del rows, content  # most of the sample; the rest of the ordinary text is not needed
    give_back()
    body = b"".join(ordinary)
    at = min(SHARED, len(body) * 3 // 4)
    shared, rest = body[:at], body[at:]
    ordinary = ordinary[:100_000]
    chosen = telling(toxic, shared, rest)
    size = min(OWN, max(1000, sum(map(len, chosen)) // DENSE))
    own, other = trained(chosen, size), trained(ordinary[: max(20_000, len(chosen))], size)
    model = Model(other + shared, own + shared, empty, empty, empty, empty)
    gains, label = [model.gains(t) for t, _ in calibration], np.array([y for _, y in calibration])
    count = [np.bincount(np.concatenate([g for g, y in zip(gains, label, strict=True) if y == k]) - LOW, minlength=HIGH - LOW + 1) + 1.0 for k in (0, 1)]
    model.ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = np.array([model.features(g) for g in gains])
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(len(w)), x.T @ (p - label) + 0.5 * w)
    model.weights = w
    del model._pair  # workers make their own
    return model


def held_out(key: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves this rest; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == rest


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most about FIT_ROWS labelled rows that are not held out, by the hash of their key, in its order, up to FIT_CHARS.

    A key with several labels has the largest. The labels that are chosen, FIT_ROWS in the mean, are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(~held_out(key, 5, 0)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    part = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    chosen = known.where(part < int((1 << 30) * min(1.0, FIT_ROWS / max(1, n))))
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select("y", F.coalesce(text, F.lit("")).alias("t"), part.alias("h")).distinct()
    out, size = [], 0
    for r in rows.orderBy("h", "t").toLocalIterator():
        size += len(r["t"])
        if size > FIT_CHARS:
            break
        out.append((r["t"], int(r["y"] > 0)))
    return out


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: all columns of ``docs``, then ``toxic_score`` (0 to 1).

    The model is fitted on the driver from a bounded sample (see ``sample``) and broadcast (about 8 MB). One pass,
    no shuffle of texts. Defined cases: null and empty texts are scored as one empty window; repeated rows are
    scored each; without labels every score is 0; clashing columns keep their values, as toxic_score replaces
    only a column of its own name.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, "toxic", key, text)))
    give_back()
    docs = docs.drop("toxic_score")
    at, names = docs.columns.index(text), [*docs.columns, "toxic_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, end, texts in slices(batch.column(at)):
                part = batch.slice(i, end - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([model.value.score(t) for t in texts], pa.float64())], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("toxic_score", DoubleType()))
