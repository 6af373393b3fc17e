"""Operator 5: near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import components, cut, ship
from quillmine.llm.shingles import shingled, text_key, words
from quillmine.llm.totals import total

#: Document frequencies are kept by hash in so many counters: 8 MB, whatever the corpus.
COUNTERS = 1 << 20
#: Samples of a sketch: BANDS bands of ROWS. A pair of similarity 0.8 shares a band with probability 0.9992.
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
#: Two sketches of a pair of similarity 0.8 agree in fewer samples once in a million pairs.
AGREE = 13
#: Members that one copy of a leader's text is compared with, and rows of a block of a bucket.
SALT, BLOCK = 256, 256
#: Shared elements that are compared at a time.
COLUMNS = 4096
_POINTS = 1 << 16


def _randoms() -> tuple[np.ndarray, ...]:
    """Per point of a table r, 1 / r and ln c of Gamma(2, 1) and beta of U(0, 1); per sample an odd multiplier that picks a shingle's point."""
    g = np.random.default_rng(20240229)
    gamma = lambda: -np.log(g.random(_POINTS) * g.random(_POINTS) + 1e-300)
    r, c, beta = gamma(), gamma(), g.random(_POINTS)
    odd = g.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32), beta.astype(np.float32), odd


_R, _ONE_R, _LNC, _BETA, _ODD = _randoms()


def counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def idf_table(counts: np.ndarray, n: int) -> np.ndarray:
    """1 + ln(n / df) / ln(n) for each counter, between 1 and 2.

    A counter holds the documents of all shingles with its hash. The mean of the other counters is taken off
    as what such strangers add. The bounded form keeps copies alike: what all copies of a large group share is
    frequent, and an unbounded weight would let the few words that differ decide.
    """
    strangers = (counts.sum() - counts) / max(1, len(counts) - 1)
    df = np.clip(counts - strangers, 1, max(1, n))
    return (1 + np.log(max(2, n) / df) / np.log(max(2, n))).astype(np.float32)


def sketch(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of SAMPLES 32-bit values for each (shingles, weights); equal values mean the same shingle was sampled at the same level."""
    sizes = np.array([len(s) for s, _ in docs])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    s = np.concatenate([s for s, _ in docs])
    ln = np.log(np.concatenate([w for _, w in docs])).astype(np.float32)
    out = np.empty((len(docs), SAMPLES), np.int32)
    for k in range(SAMPLES):
        at = ((s * _ODD[k]) >> np.uint64(48)).view(np.int64)
        beta = _BETA.take(at)
        t = _ONE_R.take(at)
        t *= ln
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a += 1
        a *= _R.take(at)
        np.subtract(_LNC.take(at), a, out=a)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        first = least[np.searchsorted(least, starts)]  # of equal values that of the smallest hash
        mixed = (s[first] ^ (t[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - both)


def weighted(text: str | list[str] | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, n = shingled(text if isinstance(text, list) else words(text))
    return s, (n * idf[counter(s)]).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """The counters over all documents, and the number of documents with a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        sums, held, size = np.zeros(COUNTERS + 1, np.int64), [], 0
        for batch in batches:
            for value in batch.column(0):
                s, _ = shingled(words(value.as_py()))
                if len(s):
                    sums[-1] += 1
                    held.append(counter(s))
                    size += len(s)
                    if size > 1 << 20:
                        sums[:-1] += np.bincount(np.concatenate(held), minlength=COUNTERS)
                        held, size = [], 0
        if held:
            sums[:-1] += np.bincount(np.concatenate(held), minlength=COUNTERS)
        return sums if sums[-1] else None

    sums = total(docs.select(text), count, COUNTERS + 1)
    return sums[:-1], int(sums[-1])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents whose weighted Jaccard similarity of five-word TF-IDF shingles reaches ``threshold``.

    Returns for each row the key, ``component_id`` (the smallest key of its group, its own if it is alone) and
    ``kept`` (it is the smallest). Weights are the count of a shingle times its bounded idf (see idf_table).

    Defined cases: a text that is null, empty or white space alone links with nothing; texts of the same words in
    any case are copies; one of fewer than five words is a single shingle; a row with a null key is kept, with a
    null component; rows that share a key are one document for ``kept``; an empty table gives an empty result;
    other columns are not read.

    Plan: two passes over the texts (frequencies, sketches) that shuffle neither text nor shingles. Copies are
    one class. Bands of sketches are buckets; each member is verified against the bucket's first class, whose
    text is sent once for SALT members. Buckets whose members are then still in several groups are searched block
    by block for members of different groups whose sketches agree in AGREE samples; such members form chains, and all
    texts of a chain are compared, again by blocks. Both return a forest, never the pairs, and no task holds more than
    two blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    counts, n = document_frequencies(docs, text)
    idf = spark.sparkContext.broadcast(idf_table(counts, n))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, keys, size = 0, [], [], 0
            for i, value in enumerate(batch.column(1)):
                ws = words(value.as_py())
                keys.append(text_key(ws) if ws else None)
                held.append(weighted(ws, idf.value))
                size += len(ws)
                if size >= 1 << 16 or i + 1 == batch.num_rows:
                    full = [x for x in held if len(x[0])]
                    found = iter(sketch(full)) if full else iter(())
                    made = [next(found).tobytes() if len(x[0]) else None for x in held]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], ["id", "c", "sketch"])
                    at, held, keys, size = i + 1, [], [], 0

    drawn = cut(rows.mapInArrow(sketched, f"id {kind}, c binary, sketch binary"))
    linkable = drawn.where("id is not null and c is not null")
    classes = cut(linkable.groupBy("c").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")))
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)])
    posted = classes.select("c", F.explode(bands).alias("bucket"))
    full = cut(posted.groupBy("bucket").agg(F.min("c").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut(posted.join(full, "bucket"))
    tried = cut(members.where("c <> leader").groupBy(F.col("leader").alias("a"), F.col("c").alias("b")).agg(F.max("n").alias("n")))
    links = cut(_verified(tried, classes, rows, threshold, idf))
    groups = components(links, "a", "b")
    placed = members.join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c")).select("bucket", "n", "c", "g")
    mixed = placed.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("bucket")
    rest = cut(placed.join(mixed, "bucket").join(classes.select("c", "sketch"), "c"))
    chains = components(cut(_agreeing(rest)), "a", "b")
    if not chains.isEmpty():
        alike = rest.select("c", "g").distinct().join(chains.select(F.col("node").alias("c"), F.col("component").alias("chain")), "c")
        links = links.unionAll(cut(_compared(cut(alike), classes, rows, threshold, idf)))
        groups = components(links, "a", "b")
    named = classes.select("c", "id").join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    named = cut(named.select("c", "id", "g"))
    smallest = named.groupBy("g").agg(F.min("id").alias("component_id"))
    of_class = named.join(smallest, "g").select("c", "component_id")
    out = linkable.select("id", "c").join(of_class, "c").select("id", "component_id")
    alone = drawn.where("id is null or c is null").select("id", F.col("id").alias("component_id"))
    return out.unionAll(alone).select(F.col("id").alias(key), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows once for each pair (i <= j) of blocks of their group that holds their own ``block``; needs ``n``, the group's size."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "n")


def _sides(k: tuple, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both blocks, or all rows twice if it is one block with itself."""
    first = (b["block"] == k[1]).to_numpy()
    return (np.flatnonzero(first), np.flatnonzero(~first)) if k[1] != k[2] else (np.arange(len(b)), np.arange(len(b)))


def _forest(r: np.ndarray, c: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """Edges (a, b) that connect what the pairs of rows connect, fewer than there are rows."""
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(r.tolist(), c.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((names[x], names[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def _agreeing(rest: DataFrame) -> DataFrame:
    """Edges that connect all classes of one bucket which are in different groups and whose sketches agree in AGREE samples."""

    def compare(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(b["sketch"]), np.int32).reshape(len(b), SAMPLES)
        left, right = _sides(k, b)
        group = np.unique(b["g"].to_numpy(), return_inverse=True)[1]
        same = np.zeros((len(left), len(right)), np.int16)
        for s in range(SAMPLES):
            same += x[left, s][:, None] == x[right, s]
        r, c = np.nonzero((same >= AGREE) & (group[left][:, None] != group[right]))
        return _forest(left[r], right[c], b["c"].to_numpy())

    return _blocks(rest).groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def _compared(alike: DataFrame, classes: DataFrame, rows: DataFrame, threshold: float, idf) -> DataFrame:
    """Edges that connect all classes of one chain which are in different groups and reach the threshold, by their texts.

    Counts are levels: a shingle that occurs twice is two elements of the shingle's weight, so that what two texts
    share is a product of matrices with one column an element.
    """
    sized = alike.join(alike.groupBy("chain").agg(F.count(F.lit(1)).alias("n")), "chain").join(classes.select("c", "id"), "c")
    read = _blocks(sized).join(rows.where("id is not null"), "id").select("chain", "i", "j", "block", "c", "g", "text")

    def compare(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        texts = [words(t) for t in b["text"]]
        right_one = np.array([text_key(w) == c for w, c in zip(texts, b["c"], strict=True)])
        b = b[right_one]
        levels, totals = [], []
        for w in (w for w, ok in zip(texts, right_one, strict=True) if ok):
            s, n = shingled(w)
            level = np.concatenate([np.arange(m) for m in n]) if len(n) and n.max() > 1 else np.zeros(len(s), np.int64)
            s = np.repeat(s, n)
            levels.append((s ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.sqrt(idf.value[counter(s)].astype(np.float64))))
            totals.append(float((levels[-1][1] ** 2).sum()))
        left, right = _sides(k, b)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        all_elements = np.concatenate([e for e, _ in levels])
        names, at, times = np.unique(all_elements, return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1  # elements of one text alone are not shared
        owner, weight = np.repeat(np.arange(len(b)), [len(e) for e, _ in levels]), np.concatenate([w for _, w in levels])
        keep = times[at] > 1
        owner, weight, column = owner[keep], weight[keep], place[at[keep]]
        order = np.argsort(column, kind="stable")
        owner, weight, column = owner[order], weight[order], column[order]
        both = np.zeros((len(left), len(right)))
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            p, q = np.searchsorted(column, [lo, lo + COLUMNS])
            x = np.zeros((len(b), min(COLUMNS, int(column[-1]) + 1 - lo)))
            x[owner[p:q], column[p:q] - lo] = weight[p:q]
            both += x[left] @ x[right].T
        size = np.array(totals)
        group = np.unique(b["g"].to_numpy(), return_inverse=True)[1]
        alike = both >= threshold * (size[left][:, None] + size[right] - both) - 1e-12
        r, c = np.nonzero(alike & (group[left][:, None] != group[right]))
        return _forest(left[r], right[c], b["c"].to_numpy())

    return read.groupBy("chain", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, threshold: float, idf) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold, by reading their texts.

    ``n`` is the size of their largest bucket: the members of a leader are dealt to so many tasks as it fills, which no
    count by leader is needed for. A text comes by its id; where several texts have one id, its key tells the right one.
    """
    salt = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT).cast("int"))).cast("int")
    dealt = pairs.select("a", "b", salt.alias("salt"))
    wanted = dealt.select("a", "salt", F.col("b").alias("c"), F.lit(1).alias("role")).unionAll(dealt.select("a", "salt", F.col("a").alias("c"), F.lit(0).alias("role")).distinct())
    named = wanted.join(classes.select("c", "id"), "c")
    full = named.join(rows.where("id is not null"), "id").select("a", "salt", "role", "c", "text")
    ordered = full.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, None
        for batch in batches:
            a, salts, roles, names, texts = batch.columns
            left, right = [], []
            for i in range(batch.num_rows):
                ws = words(texts[i].as_py())
                if text_key(ws) != names[i].as_py():
                    continue
                here = a[i].as_py(), salts[i].as_py()
                if roles[i].as_py() == 0:
                    if at != here:
                        at, leader = here, weighted(ws, idf.value)
                elif at == here and similarity(leader, weighted(ws, idf.value)) >= threshold:
                    left.append(here[0])
                    right.append(names[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return ordered.mapInArrow(verify, "a binary, b binary").distinct()
