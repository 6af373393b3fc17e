"""Operator 6: benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import cut, ship
from quillmine.llm.totals import total

#: Words of a block; a passage of the decomposition and a window of the search are two blocks.
BLOCK = 24
#: Passages of items that one pass over the corpus serves, and dimensions of the latent space beyond their number.
ITEMS, EXTRA = 256, 64
#: Terms up to which a task counts pairs of them (64 MB), and keys up to which they are broadcast (8 MB).
DENSE, FEW_KEYS = 4096, 1_000_000
#: Terms in a larger share of passages carry no weight, unless an item has fewer than FEW_TERMS others.
COMMON, FEW_TERMS = 0.02, 3
#: A window is a candidate if its projection on a passage (1: it holds all of it) and its cosine with it reach these bounds;
#: an item is found from these shares of its words.
CANDIDATE, COSINE, SURE, POSSIBLE, ANSWER = 0.4, 0.3, 0.8, 0.6, 0.8
#: Words of one document that are scored at a time, and terms that are gathered at a time.
PIECE, GATHER = 1 << 16, 1 << 15
_STRIP = ".,!?;:\"'()[]|"
_MOST_WORDS = 400_000


def tokens(text: str | None) -> list[str]:
    return [x for x in (w.strip(_STRIP) for w in (text or "").lower().split()) if x]


class _Terms(dict):
    """The number of a word's term, -1 for a word that no item has, -2 for one that is punctuation alone."""

    def __init__(self, base: dict[str, int]):
        super().__init__()
        self.base = base

    def __missing__(self, word: str) -> int:
        bare = word.strip(_STRIP)
        self[word] = n = self.base.get(bare, -1) if bare else -2
        return n

    def ids(self, text: str | None) -> np.ndarray:
        """The term of every token of a text."""
        if len(self) > _MOST_WORDS:
            self.clear()
        words = (text or "").lower().split()
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out[out > -2]


@dataclass
class Item:
    key: object
    words: list[str]
    answer: list[str] = field(default_factory=list)


def item(key: object, text: str | None, answer: str | None = None) -> Item:
    """A benchmark item. Its answer is given, or follows the last ``answer:``, or is its last sentence of three words or more."""
    text = text or ""
    if answer is None:
        head, mark, tail = text.lower().rpartition("answer:")
        sentences = [s for s in (tokens(p) for p in text.replace("?", ".").replace("!", ".").split(".")) if len(s) >= 3]
        return Item(key, tokens(text), tokens(tail) if mark else sentences[-1] if sentences else [])
    return Item(key, tokens(text) + tokens(answer), tokens(answer))


def passages(items: list[Item]) -> list[tuple[int, list[str]]]:
    """(item, words) of the even parts of each item that a window can hold; an item of up to a window is its only passage."""
    out = []
    for k, x in enumerate(items):
        n = max(1, -(-len(x.words) // (2 * BLOCK)))
        at = [len(x.words) * i // n for i in range(n + 1)]
        out += [(k, x.words[a:b]) for a, b in zip(at, at[1:], strict=False)]
    return out


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """The length of the longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each group; ``at`` is in order."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _packed(ids: np.ndarray, terms: int) -> bytes:
    return (ids + 1).astype("<u2" if terms < 65_535 else "<u4").tobytes()


def _unpacked(held: bytes, terms: int) -> np.ndarray:
    return np.frombuffer(held, "<u2" if terms < 65_535 else "<u4").astype(np.int32) - 1


def tokenized(rows: DataFrame, base: dict[str, int], key: str) -> DataFrame:
    """(key, ids): the term of each token of every text, two bytes each."""
    sent = rows.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_packed(terms.ids(t.as_py()), len(terms.base)) for t in part.column(1)], pa.binary())], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids binary")


def _passages(batches: Iterator[pa.RecordBatch], terms: int, live: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(terms, their passage, number of passages) of tokenised texts, about GATHER terms at a time; only live terms if given."""
    ids, at, held, n = [], [], 0, 0
    for batch in batches:
        for value in batch.column(0):
            t = _unpacked(value.as_py(), terms)
            keep = np.flatnonzero(t >= 0)
            if live is not None:
                keep = keep[live[t[keep]]]
            ids.append(t[keep])
            at.append(n + keep // (2 * BLOCK))
            n += -(-len(t) // (2 * BLOCK))
            held += len(keep)
            if held >= GATHER:
                yield np.concatenate(ids), np.concatenate(at), n
                ids, at, held, n = [], [], 0, 0
    if n:
        yield np.concatenate(ids), np.concatenate(at), n


def frequencies(ids: DataFrame, terms: int) -> np.ndarray:
    """In how many passages of all texts each term occurs, and last the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = np.zeros(terms + 1, np.int64)
        for i, at, n in _passages(batches, terms, None):
            out[:-1] += np.bincount(np.unique(at.astype(np.int64) * terms + i) % terms, minlength=terms)
            out[-1] += n
        return out if out[-1] else None

    return total(ids, run, terms + 1)


def sketch(ids: DataFrame, weight: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """AᵀAΩ over the weighted passages A of all texts.

    Up to DENSE terms a task counts how often each two terms share a passage and multiplies once; beyond, it projects
    each passage.
    """
    terms = len(weight)
    sent = ids.sparkSession.sparkContext.broadcast((weight, omega * weight[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        weight, test = sent.value
        shared = np.zeros(terms * terms if terms <= DENSE else 0, np.int32)
        out, some = np.zeros(test.shape), False
        for i, at, n in _passages(batches, terms, weight > 0):
            some = True
            if terms <= DENSE:
                for d in range(2 * BLOCK):
                    same = np.flatnonzero(at[: len(at) - d] == at[d:])
                    if not len(same):
                        break
                    np.add.at(shared, i[same].astype(np.int64) * terms + i[same + d], 1)
            elif len(i):
                y = _sums(test[i], at - at[0], int(at[-1] - at[0]) + 1)
                order = np.argsort(i, kind="stable")
                out += _sums(y[(at - at[0])[order]], i[order], terms)
        if some and terms <= DENSE:
            c = shared.reshape(terms, terms).astype(np.float32)
            t = test.astype(np.float32)
            out = (c @ t).astype(np.float64) + c.T @ t - np.diagonal(c)[:, None] * test
        return out * weight[:, None] if some else None

    return total(ids, run, omega.size, "float64").reshape(omega.shape)


def right_vectors(gram_sketch: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Orthonormal rows close to the leading right singular vectors of A, from AᵀAΩ alone (Nyström form)."""
    q, r = np.linalg.qr(gram_sketch)
    core = omega.T @ gram_sketch
    core = (core + core.T) / 2
    shift = 1e-10 * max(np.trace(core), 1e-300) / max(1, len(core))
    values, vectors = np.linalg.eigh(core + shift * np.eye(len(core)))
    half = r @ vectors / np.sqrt(np.maximum(values, shift))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return (q @ u[:, s > 1e-9 * max(s[0], 1e-300)]).T


@dataclass
class Space:
    """The latent space: for each term its coordinates, and what it adds to a window's projection on each passage of the items."""

    terms: np.ndarray
    adds: np.ndarray
    sizes: np.ndarray  # lengths of the passages

    def __post_init__(self) -> None:
        self.top = self.adds.clip(0).max(axis=1) if self.adds.size else np.zeros(len(self.adds), np.float32)


def _model(ids: DataFrame, base: dict[str, int], parts: list[list[str]], seed: int) -> Space:
    df = frequencies(ids, len(base))
    n = max(1, int(df[-1]))
    common = df[:-1] > COMMON * n
    of = [np.array([base[w] for w in ws], np.int64) for ws in parts]
    for own_ids in of:
        if len(set(own_ids[~common[own_ids]].tolist())) < FEW_TERMS:
            common[own_ids] = False
    weight = np.where(common, 0.0, np.log((1 + n) / (1 + df[:-1])) + 1e-3)
    own = np.zeros((len(parts), len(base)))
    for k, own_ids in enumerate(of):
        np.add.at(own[k], own_ids, weight[own_ids])
    rank = min(len(base), len(parts) + EXTRA)
    omega = np.random.default_rng(seed).standard_normal((len(base), rank))
    of_corpus = sketch(ids, weight, omega)
    of_items = own.T @ (own @ omega)
    # the items are passages too; together they weigh as much as the corpus, so that the space holds their rare terms
    more = max(1.0, float(np.linalg.norm(of_corpus)) / max(float(np.linalg.norm(of_items)), 1e-300))
    v = right_vectors(of_corpus + more * of_items, omega)
    latent = own @ v.T
    size = (latent * latent).sum(axis=1)
    terms = weight[:, None] * v.T
    adds = terms @ latent.T / np.where(size > 0, size, np.inf)
    return Space(terms.astype(np.float32), adds.astype(np.float32), np.sqrt(size))


def candidates(ids: np.ndarray, space: Space) -> Iterator[tuple[int, int, float]]:
    """(first token, passage of an item, cosine) of the windows of one text that reach CANDIDATE and COSINE.

    Windows whose terms add less than CANDIDATE to any passage at the most cannot reach it; others are projected on all
    passages, and those that reach it are given their length in latent space, which makes a projection a cosine.
    """
    top = space.top
    for start in range(0, max(1, len(ids)), PIECE):
        lo = max(0, start - BLOCK)
        t = ids[lo : start + PIECE]
        keep = np.flatnonzero(t >= 0)
        keep = keep[top[t[keep]] > 0]
        if not len(keep):
            continue
        n, block = -(-len(t) // BLOCK) + 1, keep // BLOCK
        most = np.bincount(block, top[t[keep]], n)
        hot = most[:-1] + most[1:] >= CANDIDATE
        if not hot.any():
            continue
        used = np.r_[hot, False] | np.r_[False, hot]
        keep, block = keep[used[block]], block[used[block]]
        sums = _sums(space.adds[t[keep]], block, n)
        windows = sums[:-1] + sums[1:]
        at, passage = np.nonzero((windows >= CANDIDATE) & hot[:, None])
        for w in np.unique(at).tolist():
            held = t[w * BLOCK : (w + 2) * BLOCK]
            size = float(np.linalg.norm(space.terms[held[held >= 0]].sum(axis=0)))
            for k in passage[at == w].tolist():
                cosine = float(windows[w, k]) * float(space.sizes[k]) / max(size, 1e-300)
                if cosine >= COSINE:
                    yield lo + w * BLOCK, k, cosine


def find(ws: list[str], ids: np.ndarray, space: Space, items: list[Item], owner: list[int]) -> list[tuple[int, float, float, int, int]]:
    """The items found in one text: (item, cosine, share of its words, first word, end), the best place of each."""
    best: dict[int, tuple[int, float, float, int, int]] = {}
    most: dict[tuple[int, int], float] = {}  # a window may reach several passages of one item, which is verified once
    for at, p, score in candidates(ids, space):
        most[at, owner[p]] = max(score, most.get((at, owner[p]), score))
    for (at, k), score in most.items():
        x = items[k]
        a, b = max(0, at - len(x.words)), min(len(ws), at + 2 * BLOCK + len(x.words))
        region = ws[a:b]
        share = lcs(x.words, region) / len(x.words)
        if share >= SURE or share >= POSSIBLE and x.answer and lcs(x.answer, region) >= ANSWER * len(x.answer):
            if k not in best or (share, score) > (best[k][2], best[k][1]):
                best[k] = (k, score, share, a, b)
    return [best[k] for k in sorted(best)]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """Every (document, benchmark item) where the document holds the item, verbatim or as a paraphrase.

    Returns the key, the item's key, ``cosine`` (of the best window with a passage of the item in latent space), ``share`` (of
    the item's words in a longest common subsequence with the place), and the place's ``first`` word and ``end``. An
    item is found where the share is at least SURE, or at least POSSIBLE with the answer's words (see ``item``).

    Terms are the words of the items. Passages of all texts give their document frequencies and, in a second pass, the
    randomised singular value decomposition of the TF-IDF matrix; a third pass searches all windows of all texts.
    Terms of more than a share COMMON of passages carry no weight, as words of all texts say nothing about an item.
    Projections are linear, so a term's part in each of them is a table and a window adds up its rows; a window that holds
    enough of a passage is a candidate by its cosine. Items longer than a window are searched by their passages; what is
    verified around any of them is the whole item.

    Defined cases: null and empty texts and items are found nowhere; an item of frequent terms alone keeps them;
    repeated documents are searched each; repeated items are returned each; empty tables give an empty result; a null
    key stays null; other columns are not read.

    Items are taken ITEMS passages, or DENSE terms, at a time from a driver-side iterator, which bounds what is broadcast; each
    such block reads the texts once and their terms three times, and reads again the texts that have a candidate. Keys of
    these are broadcast up to FEW_KEYS; beyond, texts are joined by a shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(key, text)
    kind, item_kind = rows.schema[0].dataType.simpleString(), benchmark.schema[item_key].dataType
    schema = f"`{key}` {kind}, at int, cosine double, share double, first int, end int"
    out = None
    chosen = benchmark.select(F.col(item_key), F.col(item_text), F.col(answer) if answer else F.lit(None).cast("string"))

    def searched(items: list[Item], seed: int) -> DataFrame:
        base = {w: i for i, w in enumerate(dict.fromkeys(w for x in items for w in x.words))}
        ids = cut(tokenized(rows, base, key))
        parts = passages(items)
        space = _model(ids.select("ids"), base, [ws for _, ws in parts], seed)
        sent = spark.sparkContext.broadcast((base, space, items, [k for k, _ in parts]))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, space, *_ = sent.value
            for batch in batches:
                hit = [next(candidates(_unpacked(t.as_py(), len(base)), space), None) is not None for t in batch.column(1)]
                yield batch.filter(pa.array(hit, pa.bool_())).select([0])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, space, items, owner = sent.value
            terms = _Terms(base)
            for batch in batches:
                at, found = [], []
                for i, value in enumerate(batch.column(1)):
                    t = value.as_py()
                    hits = find(tokens(t), terms.ids(t), space, items, owner)
                    at += [i] * len(hits)
                    found += hits
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()), strict=True)]], [key, "at", "cosine", "share", "first", "end"])

        picked = cut(ids.mapInArrow(pick, f"`{key}` {kind}").distinct()).withColumnRenamed(key, "picked")
        picked = F.broadcast(picked) if picked.count() <= FEW_KEYS else picked
        hits = rows.join(picked, F.col(key).eqNullSafe(F.col("picked")), "left_semi").mapInArrow(verify, schema)
        names = spark.createDataFrame([(i, x.key) for i, x in enumerate(items)], f"at int, `{item_key}` {item_kind.simpleString()}")
        return cut(hits.join(F.broadcast(names), "at").select(key, item_key, "cosine", "share", "first", "end"))

    block: list[Item] = []
    seen: set[str] = set()
    n_blocks = n_parts = 0
    for r in chosen.orderBy(item_key, item_text).toLocalIterator():
        x = item(r[0], r[1], r[2])
        if not x.words:
            continue
        n = len(passages([x]))
        if block and (n_parts + n > ITEMS or len(seen | set(x.words)) > DENSE):
            done = searched(block, n_blocks)
            out, block, seen = done if out is None else out.unionAll(done), [], set()
            n_blocks, n_parts = n_blocks + 1, 0
        n_parts += n
        block.append(x)
        seen |= set(x.words)
    if block:
        done = searched(block, n_blocks)
        out = done if out is None else out.unionAll(done)
    if out is None:
        return spark.createDataFrame([], f"`{key}` {kind}, `{item_key}` {item_kind.simpleString()}, cosine double, share double, first int, end int")
    return out
