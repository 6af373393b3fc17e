"""Operator 10: quality classification by an interpolated modified Kneser-Ney model of bytes, kept as sharded tables.

A text's log probability is a sum over places of terms that do not depend on each other: an n-gram that was seen adds its
gain over backing off, and the weight that it leaves as a context. So one lookup a place scores a text: in a broadcast
table of the HEAD most frequent n-grams, or else by a join with the shard that holds all n-grams of the same last bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import cut, give_back, ship

#: Bytes of an n-gram; orders up to BASE are one table of 2 ** (8 * BASE) cells, the higher ones are sharded.
ORDER, BASE = 6, 3
#: N-grams that are broadcast (12 MB).
HEAD = 1 << 20
#: Bytes that are counted or scored at a time, different n-grams that a task holds, texts and lookups that it sends at a time.
PIECE, HELD, DOCS, PART = 1 << 18, 1 << 21, 4096, 1 << 19
#: One in APART trusted texts is kept apart for thresholds; a language with EVEN of them has half a threshold of its own.
APART, EVEN = 8, 100
#: Keys of trusted documents up to which they are broadcast (8 MB); above, tables are joined by a shuffle.
FEW_KEYS = 1_000_000
#: Languages up to which their thresholds are broadcast.
FEW_LANGS = 10_000

#: Bytes that UTF-8 never has stand before and behind a text.
_START, _END = b"\xff", b"\xfe"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(text: str) -> Iterator[bytes]:
    """The text's bytes with its start and end, in parts that overlap so that each n-gram falls into one of them."""
    whole = _START * ORDER + text.encode("utf-8", "surrogatepass") + _END
    for at in range(ORDER - 1, len(whole), PIECE):
        yield whole[at - ORDER + 1 : at + PIECE]


def _grams(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, the number of the piece they are from) that end at each byte, oldest byte highest; a text's first is all start."""
    x = np.frombuffer(b"".join(held), np.uint8)
    g = x[: len(x) - ORDER + 1].astype(np.uint64)
    for i in range(1, ORDER):
        g <<= np.uint64(8)
        g |= x[i : len(x) - ORDER + 1 + i]
    sizes = np.array([len(p) for p in held])
    of = np.repeat(np.arange(len(held)), sizes)
    inside = np.ones(len(x), bool)
    ends = np.cumsum(sizes)
    for i in range(1, ORDER):
        inside[ends[:-1] - i] = False
    inside = inside[: len(g)]
    return g[inside], of[: len(g)][inside]


def _packed(sorted_numbers: np.ndarray) -> bytes:
    """Numbers in order, as differences by planes of bytes."""
    gaps = np.diff(sorted_numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(numbers: np.ndarray, kind: str) -> bytes:
    n = np.ascontiguousarray(numbers.astype(kind))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(n.view(np.uint8).reshape(len(n), -1).T).tobytes())


def _large(held: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _bucket(g: np.ndarray, n: int) -> np.ndarray:
    """The shard of an n-gram: its last four bytes decide, so that it is with all that it backs off to."""
    return (((g & np.uint64(0xFFFFFFFF)) * _ODD) >> np.uint64(33)) % np.uint64(n)


def _dealt(g: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of n-grams that are in order; a shard's places stay in order."""
    b = _bucket(g, n)
    order = np.argsort(b, kind="stable")
    b = b[order]
    ends = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)] if len(b) else np.zeros(1, np.int64)
    for i, j in zip(ends, ends[1:], strict=False):
        yield int(b[i]), order[i:j]


def _suffix(n: int) -> Column:
    return F.col("g").bitwiseAND((1 << 8 * n) - 1)


def _shards(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count(trusted: DataFrame, text: str = "text") -> DataFrame:
    """(g, c): how often each n-gram of ORDER occurs in all texts. A task sends each of its n-grams once for HELD of them."""
    ship(trusted.sparkSession)
    n = _shards(trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        seen: list[tuple[np.ndarray, np.ndarray]] = []  # (n-grams in order, how often), the first the sum of earlier ones

        def counted() -> None:
            g = _grams(held)[0]
            seen.append(np.unique(g[g != (1 << 8 * ORDER) - 1], return_counts=True))

        def merged() -> None:
            g, c = (np.concatenate(x) for x in zip(*seen, strict=True))
            every, at = np.unique(g, return_inverse=True)
            seen[:] = [(every, np.bincount(at, c, len(every)).astype(np.int64))]

        def sent() -> Iterator[pa.RecordBatch]:
            merged()
            for b, at in _dealt(seen[0][0], n):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(seen[0][0][at])], pa.binary()), pa.array([_small(seen[0][1][at], "<u8")], pa.binary())], ["bucket", "keys", "times"])
            seen.clear()

        for batch in batches:
            for value in batch.column(0):
                for piece in _pieces(value.as_py()) if value.as_py() else ():
                    held.append(piece)
                    size += len(piece)
                    if size >= 4 * PIECE:
                        counted()
                        held, size = [], 0
                        if sum(len(g) for g, _ in seen[1:]) >= max(PIECE, len(seen[0][0]) // 2):
                            merged()
                            if len(seen[0][0]) >= HELD:
                                yield from sent()
        if held:
            counted()
        if seen:
            yield from sent()

    def add(t: pa.Table) -> pa.Table:
        g, c = np.concatenate([_unpacked(x.as_py()) for x in t["keys"]]), np.concatenate([_large(x.as_py(), "<u8") for x in t["times"]])
        every, at = np.unique(g, return_inverse=True)
        return pa.table({"g": pa.array(every.astype(np.int64)), "c": pa.array(np.bincount(at, c, len(every)).astype(np.int64))})

    rows, sc = trusted.select(text), trusted.sparkSession.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") != "true":  # fewer tasks send fewer n-grams twice
        rows = rows.coalesce(2 * sc.defaultParallelism)
    return rows.mapInArrow(run, "bucket int, keys binary, times binary").groupBy("bucket").applyInArrow(add, "g long, c long")


def _discounts(often: Sequence[int]) -> list[float]:
    """What is taken off n-grams that occur once, twice and more often, from how many occur one to four times."""
    n = dict(enumerate(often, 1))
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.1) if n[k] else 0.5 * k for k in (1, 2, 3)]


def _level(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g, c, alpha, gamma) of seen n-grams, (h, gamma) of contexts): discounted probability, and weight left to lower orders.

    Counts are sharded by context and joined with the statistics of their context: its total and how many followers
    occur once, twice and more often.
    """
    d = _discounts(counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
    h = F.shiftright("g", 8).alias("h")
    stats = counts.groupBy(h).agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2)], F.count_if(F.col("c") >= 3).alias("n3"))
    stats = stats.select("h", "total", ((d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")).alias("gamma"))
    cut_off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    rows = counts.withColumn("h", h).join(stats, "h").select("g", "c", ((F.col("c") - cut_off) / F.col("total")).alias("alpha"), "gamma")
    return rows, stats.select("h", "gamma")


@dataclass
class Model:
    """What every worker has: the orders up to BASE, and the head in the order of its cells, with values."""

    seen: np.ndarray
    seen_log: np.ndarray
    context_log: np.ndarray
    lower_log: np.ndarray
    after: np.ndarray
    after_log: np.ndarray
    head: np.ndarray
    value: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def table(self) -> np.ndarray:
        """For each n-gram of BASE, its log probability and the log weight that it leaves as a context; 64 MB, made once in a worker."""
        if not hasattr(self, "_table"):
            self._table = np.repeat(self.context_log, 1 << 8)
            self._table.reshape(1 << 8, -1)[:] += self.lower_log
            self._table[self.seen] = self.seen_log
            self._table[-1] = 0  # the start has no probability
            self._table[self.after] += self.after_log
        return self._table

    def place(self, g: np.ndarray) -> np.ndarray:
        """The place of each n-gram in the head, -1 where it is not there."""
        if not hasattr(self, "_first"):
            self._first = np.searchsorted(_cell(self.head), np.arange((1 << 21) + 1)).astype(np.int32)
        c = _cell(g)
        at, end = self._first[c], self._first[c + 1]
        out, left = np.full(len(g), -1, np.int32), np.flatnonzero(at < end)
        while len(left):
            hit = self.head[at[left]] == g[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def _cell(g: np.ndarray) -> np.ndarray:
    return ((g * _ODD) >> np.uint64(43)).astype(np.int32)


def _dense(counts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of BASE in order, their probability, the weight of each context, the probability of each n-gram one shorter)."""
    g, c = counts["g"].to_numpy(), counts["c"].to_numpy()
    by_order = {BASE: (g, c)}
    for n in range(BASE - 1, 0, -1):
        by_order[n] = np.unique(by_order[n + 1][0] & ((1 << 8 * n) - 1), return_counts=True)
    lower = np.full(1, 0.5**8)
    for n in range(1, BASE + 1):
        g, c = by_order[n]
        d = np.r_[0.0, _discounts([int((c == k).sum()) for k in (1, 2, 3, 4)])][np.minimum(c, 3)]
        total = np.bincount(g >> 8, c, 1 << 8 * (n - 1))
        context = np.divide(np.bincount(g >> 8, d, len(total)), total, out=np.ones(len(total)), where=total > 0)
        p = (c - d) / total[g >> 8] + context[g >> 8] * lower[g & (len(lower) - 1)]
        if n < BASE:
            lower = np.repeat(context, 1 << 8) * np.tile(lower, 1 << 8)
            lower[g] = p
    return g, p, context, lower


def estimate(counts: DataFrame) -> tuple[Model, DataFrame]:
    """(the model of the workers, (n, g, value) of all n-grams of more than BASE bytes), by interpolation of all orders.

    Below the highest order an n-gram counts as often as different bytes come before it. ``value`` is an
    n-gram's gain over backing off and the log weight that it leaves as a context. The driver gets the n-grams of BASE, 2 ** (8 * BASE) at most and usually some hundred thousand, and the head.
    """
    by_order = {ORDER: cut(counts)}
    for n in range(ORDER - 1, BASE - 1, -1):
        by_order[n] = cut(by_order[n + 1].groupBy(_suffix(n).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    seen, seen_p, context, lower = _dense(by_order[BASE].orderBy("g").toArrow())
    base = counts.sparkSession.createDataFrame(pa.table({"g": pa.array(seen), "p": pa.array(seen_p)}))
    levels, weights = {BASE: base}, {}
    for n in range(BASE + 1, ORDER + 1):
        rows, contexts = _level(by_order[n])
        weights[n] = contexts.select("h", F.log("gamma").alias("w"))
        rows = rows.withColumn("s", _suffix(n - 1)).join(levels[n - 1].select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        p = F.col("alpha") + F.col("gamma") * F.col("q")
        levels[n] = cut(rows.select("g", "c", p.alias("p"), (F.log(p) - F.log("gamma") - F.log("q")).alias("gain")))
    after = weights[BASE + 1].toArrow()

    tables = {ORDER: levels[ORDER].select(F.lit(ORDER).alias("n"), "g", F.col("gain").alias("value"))}
    for n in range(BASE + 1, ORDER):
        both = levels[n].select("g", "gain").join(weights[n + 1], F.col("g") == F.col("h"), "full")
        tables[n] = both.select(F.lit(n).alias("n"), F.coalesce("g", "h").alias("g"), (F.coalesce("gain", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("value"))

    scale = F.floor(F.log2("c") * 64)
    least, size = 0, 0
    for r in levels[ORDER].groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect():  # some thousand rows at most
        size += r["count"]
        if size > HEAD:
            least = r["scale"] + 1
            break
    top = levels[ORDER].where(scale >= least).select("g", F.col("gain").alias("value"))
    for n in range(BASE + 1, ORDER):
        more = tables[n].select(F.col("g").alias("s"), F.col("value").alias("more"))
        top = top.withColumn("s", _suffix(n)).join(more, "s", "left").select("g", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value"))
    t = top.toArrow()
    head = t["g"].to_numpy().astype(np.uint64)
    order = np.argsort(_cell(head), kind="stable")
    model = Model(
        seen, np.log(seen_p).astype(np.float32), np.log(context).astype(np.float32), np.log(lower).astype(np.float32),
        after["h"].to_numpy().astype(np.int64), after["w"].to_numpy().astype(np.float32),
        head[order], t["value"].to_numpy()[order].astype(np.float32),
    )
    out = tables[ORDER]
    for n in range(BASE + 1, ORDER):
        out = out.unionAll(tables[n])
    return model, out


def _asked(texts: DataFrame, model, n: int) -> DataFrame:
    """For each part of a task's texts: what workers know of each text, and for each shard the n-grams to look up and their texts."""
    names = ["part", "bucket", "head", "keys", "runs", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, parts = model.value, TaskContext.get().partitionId(), 0
        at: dict[bytes, int] = {}
        log, length = np.zeros(DOCS), np.zeros(DOCS)
        wanted, asked, held, of, size = [], 0, [], [], 0

        def scored() -> int:
            """Add up the pieces that are held, and keep n-grams beyond the head to be asked for: so many."""
            g, piece = _grams(held)
            doc, place = np.array(of)[piece], m.place(g)
            value = m.table()[(g & np.uint64((1 << 8 * BASE) - 1)).view(np.int64)]
            hit, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            value[hit] += m.value[place[hit]]
            np.add(log, np.bincount(doc, value, DOCS), out=log)
            wanted.append((g[rest], doc[rest].astype(np.uint16)))
            return len(rest)

        def sent() -> Iterator[pa.RecordBatch]:
            g, doc = (np.concatenate(x) for x in zip(*wanted, strict=True))
            order = np.lexsort((doc, g))
            g, doc = g[order], doc[order]
            head = b"".join(at) + b"".join(x[: len(at)].tobytes() for x in (log, length))
            for k, (b, i) in enumerate(_dealt(g, n)):  # never empty, as no start is in the head
                x = g[i]
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                cols = [head if k == 0 else None, _packed(x[first]), _small(np.diff(np.r_[first, len(x)]), "<u4"), _small(doc[i], "<u2")]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{parts}"]), pa.array([b], pa.int32()), *[pa.array([c], pa.binary()) for c in cols]], names)

        for batch in batches:
            for h, value in zip(*batch.columns, strict=True):
                key = h.as_py()
                if key in at:
                    continue
                for i, piece in enumerate(_pieces(value.as_py())):
                    k = at.setdefault(key, len(at))
                    length[k] += len(piece) - ORDER + 1 - (i == 0)
                    held.append(piece)
                    of.append(k)
                    size += len(piece)
                    full = len(at) == DOCS
                    if size >= PIECE or full:
                        asked += scored()
                        held, of, size = [], [], 0
                    if asked >= PART or full:
                        yield from sent()
                        at, wanted, asked, parts = {}, [], 0, parts + 1
                        log[:] = length[:] = 0
        if held:
            scored()
        if at:
            yield from sent()

    return texts.mapInArrow(run, "part string, bucket int, head binary, keys binary, runs binary, docs binary")


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """What the n-grams of a shard add to each text."""
    by_order = {}
    for n in range(BASE + 1, ORDER + 1):
        of = model.filter(pa.compute.equal(model["n"], n))
        g = of["g"].to_numpy().astype(np.uint64)
        order = np.argsort(g)
        by_order[n] = g[order], of["value"].to_numpy()[order]
    rows = []
    for part, head, held, runs, docs in zip(*(asked[k].to_pylist() for k in ("part", "head", "keys", "runs", "docs")), strict=True):
        keys = _unpacked(held)
        adds = np.zeros(len(keys))
        for n, (g, value) in by_order.items():
            if len(g):
                short = keys & np.uint64((1 << 8 * n) - 1)
                at = np.minimum(np.searchsorted(g, short), len(g) - 1)
                adds += np.where(g[at] == short, value[at], 0.0)
        sums = np.bincount(_large(docs, "<u2"), np.repeat(adds, _large(runs, "<u4")))
        i = np.flatnonzero(sums)
        rows.append((part, head, i.astype(np.uint16).tobytes(), sums[i].astype(np.float32).tobytes()))
    kinds = {"part": pa.string(), "head": pa.binary(), "docs": pa.binary(), "adds": pa.binary()}
    return pa.table([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds.values(), strict=True)], list(kinds))


def _summed(table: pa.Table) -> pa.Table:
    head = next(x for x in table["head"].to_pylist() if x is not None)
    n = len(head) // 32
    log, length = (np.frombuffer(head, np.float64, n, 8 * k * n + 16 * n).copy() for k in range(2))
    for at, adds in zip(table["docs"].to_pylist(), table["adds"].to_pylist(), strict=True):
        log[np.frombuffer(at, np.uint16)] += np.frombuffer(adds, np.float32)
    return pa.table([pa.array([head[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), pa.array(log), pa.array(length)], ["h", "log", "length"])


def perplexities(texts: DataFrame, table: DataFrame, model) -> DataFrame:
    """(h, perplexity) of each different (h, text): of a byte of the whole text, its end included."""
    n = _shards(texts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g = b.column(1).to_numpy().astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(g, n).astype(np.int32)), *b.columns], ["bucket", *b.schema.names])

    shards = table.mapInArrow(dealt, "bucket int, n int, g long, value double")
    found = _asked(texts, model, n).groupBy("bucket").cogroup(shards.groupBy("bucket")).applyInArrow(_answered, "part string, head binary, docs binary, adds binary")
    sums = found.groupBy("part").applyInArrow(_summed, "h binary, log double, length double")
    # copies, and parts of a very long text, are each their share of the same mean
    return sums.groupBy("h").agg(F.exp(F.least(-F.sum("log") / F.sum("length"), F.lit(700.0))).alias("perplexity"))


def trusted_keys(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Keys of documents that are labelled as good, once each; of several labels the smallest counts."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("q")).where("q > 0").select(key)


def _upper(unseen: DataFrame, quantile: float, bound: Column) -> float | None:
    """The quantile of all logarithms; of few texts, whose largest lies below it, partly that of an exponential tail above their median."""
    middle = F.log(F.percentile_approx("perplexity", F.lit(0.5), F.lit(100_000)))
    r = unseen.agg(F.count(F.lit(1)).alias("n"), bound.alias("q"), middle.alias("middle")).first()
    if not r["n"] or quantile >= 1:
        return r["q"]
    above = F.log("perplexity") - F.lit(r["middle"])
    excess = unseen.where(above > 0).agg(F.avg(above).alias("x")).first()["x"] or 0.0
    tail = r["middle"] + excess * math.log(0.5 / (1 - quantile))
    return (r["n"] * r["q"] + EVEN * max(r["q"], tail)) / (r["n"] + EVEN)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Judge every whole text by its perplexity: all columns of ``docs``, then ``perplexity``, ``threshold`` and ``good``.

    The model counts the n-grams of ORDER bytes of all trusted texts but one in APART, chosen by the text's hash so that
    copies stay together, and its tables grow with them. They are sharded by their last four bytes and joined with the
    n-grams of all texts that are not among the HEAD most frequent ones, which are broadcast with the orders up to BASE
    (80 MB at most, and 64 MB more once unpacked). Thresholds come from the trusted texts that the model has not seen: the
    ``quantile`` of all of them (see ``_upper``), from which a language's own departs the more, the more such texts it has
    (half way for EVEN). ``good`` is a perplexity up to the threshold.

    Defined cases: a null or empty text has no perplexity and is not good; a null language is a language of its own;
    without trusted texts kept apart everything with a text is good; repeated rows are judged each; columns of ``docs``
    with the names of the results are replaced.

    The trusted keys are broadcast only up to FEW_KEYS. Perplexities are joined back by a digest of the text; thresholds
    come from mergeable quantile summaries, so that a frequent language is no single task's.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("perplexity", "threshold", "good")
    keys = cut(trusted_keys(labels, key))
    keys = F.broadcast(keys) if keys.count() <= FEW_KEYS else keys
    trusted = docs.join(keys, key, "left_semi").where(F.col(text) != "")
    apart = F.pmod(F.xxhash64(text), F.lit(APART)) == 0
    model, table = estimate(count(trusted.where(~apart), text))
    give_back()
    digest = F.unhex(F.md5(text))
    texts = docs.where(F.col(text) != "").select(digest.alias("h"), F.col(text).alias("text"))
    scores = cut(perplexities(texts, table, spark.sparkContext.broadcast(model)))
    unseen = cut(trusted.where(apart).select(F.col(lang).alias("of_language"), digest.alias("h")).join(scores, "h").select("of_language", "perplexity"))
    bound = F.log(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)))
    common = F.lit(_upper(unseen, quantile, bound)).cast("double")
    n = F.col("n")
    own = unseen.groupBy("of_language").agg(F.count(F.lit(1)).alias("n"), bound.alias("q"))
    own = cut(own.select("of_language", F.exp((n * F.col("q") + EVEN * common) / (n + EVEN)).alias("threshold")))
    own = F.broadcast(own) if own.count() <= FEW_LANGS else own
    named = docs.withColumn("own text", digest)  # a column, so that the join moves texts only if they are asked for
    scored = named.join(scores.select(F.col("h").alias("of_text"), "perplexity"), F.col("own text") == F.col("of_text"), "left").drop("of_text", "own text")
    joined = scored.join(own, scored[lang].eqNullSafe(own["of_language"]), "left").drop(own["of_language"])
    joined = joined.withColumn("threshold", F.coalesce("threshold", F.exp(common)))
    good = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.withColumn("good", good).select(*docs.columns, "perplexity", "threshold", "good")
