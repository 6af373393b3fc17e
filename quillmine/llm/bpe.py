"""Operator 7: byte-level BPE encoding and decoding with length-bucketed padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillmine.llm.common import ship

#: Matches longer than this many bytes are merged with a heap, as a matrix would take a round for each of their merges.
LONG = 256
#: Cells of one padded matrix, matches joined at a time, known matches kept by a worker, characters of one returned batch.
CELLS, PIECE, KNOWN, BATCH_CHARS = 1 << 20, 200_000, 300_000, 1 << 20
_NONE = np.int32(2**31 - 1)
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes text by ranks as tiktoken does: a match that is a token is one id; any other is merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"ranks lack single bytes: {missing[:5]}")
        self.ranks, self.find = ranks, regex.compile(pattern).finditer
        self.find_all = regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        self.bits = max(4, (4 * max(1, len(pairs))).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        if pairs:
            todo = np.array([a << 32 | b for a, b in pairs], np.int64)
            value, at = np.fromiter(pairs.values(), np.int32, len(pairs)), self._slot(todo)
            while len(todo):  # all that found a free slot, the first of each slot, stay; the rest move on by one
                first = np.zeros(len(todo), bool)
                first[np.unique(at, return_index=True)[1]] = True
                put = first & (self.keys[at] < 0)
                self.keys[at[put]], self.values[at[put]] = todo[put], value[put]
                todo, value, at = todo[~put], value[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.known: dict[str, bytes] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids (also the merged token's id), or _NONE; padding is negative."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(key.shape, _NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(key.ravel()[todo])
        while len(todo):
            held, want = self.keys[at], key.ravel()[todo]
            hit = held == want
            out.ravel()[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of similar length: in each round every row merges its leftmost pair of minimum rank.

        Rows that are done leave the matrix, and columns that hold nothing but padding go with them.
        """
        width = max(map(len, words))
        ids = np.full((len(words), width), -1, np.int32)
        sizes = np.array([len(w) for w in words])
        ids[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        done = np.full((len(words), width), -1, np.int32)
        rows, rank = np.arange(len(words)), self.lookup(ids[:, :-1], ids[:, 1:])
        while len(rows):
            over = (rank.min(axis=1) == _NONE) if rank.shape[1] else np.ones(len(rows), bool)
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                rows, ids, rank = rows[~over], ids[~over], rank[~over]
                continue
            i, at = np.arange(len(rows)), rank.argmin(axis=1)
            ids[i, at] = rank[i, at]
            keep = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            ids = np.take_along_axis(ids, keep, 1)  # the right half of the merged pair goes
            rank = np.take_along_axis(rank, keep[:, :-1], 1)
            for j in (at - 1, at):
                ok = (j >= 0) & (j < rank.shape[1])
                rank[i[ok], j[ok]] = self.lookup(ids[i[ok], j[ok]], ids[i[ok], j[ok] + 1])
            if len(used := np.flatnonzero((ids >= 0).any(axis=0))) < ids.shape[1]:  # columns that are padding everywhere go
                ids = ids[:, : used[-1] + 1]
                rank = rank[:, : used[-1]]
        flat, ends = done[done >= 0].astype("<u4").tobytes(), np.cumsum((done >= 0).sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for one long word, by a heap of (rank, place) and links to neighbours."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or self.pairs.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p in (left[i], i):
                if p >= 0 and right[p] >= 0 and (s := self.pairs.get((ids[p], ids[right[p]]))) is not None:
                    heapq.heappush(heap, (s, p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: list[str]) -> None:
        """Make the ids of these matches known, as little-endian bytes."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(b)) is not None:
                self.known[w] = whole.to_bytes(4, "little")
            elif len(b) > LONG:
                self.known[w] = self.merge_long(b)
            else:
                buckets.setdefault((len(b) - 1).bit_length(), []).append((w, b))
        for bits, items in buckets.items():
            step = max(1, CELLS >> bits)
            for k in range(0, len(items), step):
                part = items[k : k + step]
                self.known.update(zip([w for w, _ in part], self.merge_rows([b for _, b in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        count = 0
        for i, text in enumerate(texts):
            for piece in [self.find_all(text)] if len(text) <= PIECE else self._pieces(text):
                held.append((i, piece))
                count += len(piece)
                if count >= PIECE:
                    self._join(held, out)
                    held, count = [], 0
        self._join(held, out)
        return [b"".join(x) for x in out]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        matches = self.find(text)
        while piece := [m[0] for m in islice(matches, PIECE)]:
            yield piece

    def _join(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        words = set().union(*(piece for _, piece in held))
        new = words.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = words
        self.encode_words([*new])
        for i, piece in held:
            out[i].append(b"".join(map(self.known.__getitem__, piece)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """The worker's encoder of these ranks, made once."""
    key = hashlib.sha256(ranks).hexdigest(), pattern
    if key not in _ENCODERS:
        lines = (line.split() for line in ranks.splitlines() if line.strip())
        _ENCODERS[key] = Encoder({base64.b64decode(a): int(b) for a, b in lines}, pattern)
    return _ENCODERS[key]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """A column's texts by parts of about BATCH_CHARS (one text at least); null is the empty text."""
    at, part, size = 0, [], 0
    for i, value in enumerate(texts):
        part.append(value.as_py() or "")
        size += len(part[-1])
        if size >= BATCH_CHARS:
            yield at, i + 1, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, len(texts), part


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: key, ``ids`` (little-endian unsigned 32-bit), ``decoded`` (UTF-8).

    Each match of the pattern is encoded separately; special tokens are ordinary text. Defined cases: a null or
    empty text has no ids and decodes to nothing; repeated rows are encoded each; texts of any length are
    encoded in pieces of PIECE matches; an empty table gives an empty result; other columns are not read.

    The file of ranks is read by the driver and broadcast as it is (under 1 MB for 50,000 tokens). No shuffle;
    a worker holds PIECE matches, KNOWN known ones and a batch of BATCH_CHARS (or one text) at most.
    """
    ship(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(key, text)
    kind = rows.schema[0]
    names = [kind.name, "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, pattern)
        for batch in batches:
            for at, end, texts in slices(batch.column(1)):
                ids = enc.encode(texts)
                back = [enc.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names)

    return rows.mapInArrow(run, f"`{kind.name}` {kind.dataType.simpleString()}, ids binary, decoded binary")
