"""Operator 3: embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import components, cut, ship

#: Rows of one block of an inverted list; a task compares two blocks, CHUNK rows of one of them at a time.
BLOCK, CHUNK = 2048, 256
#: Longer lists are split by a second pivot if that leaves less than half of the pairs to compare.
LONG = 8 * BLOCK
#: Vectors read to choose pivots from, and the largest number of pivots: both bound what the driver holds.
SAMPLE, MOST = 8192, 4096


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: list[list[float]], n: int, apart: float = 0.8) -> np.ndarray:
    """At most n reference points out of the sample, in its order, of which no two have a cosine above ``apart``."""
    x = units(np.array(sample, np.float64))
    chosen, free = [], np.ones(len(x), bool)
    for i in range(len(x)):
        if free[i]:
            chosen.append(i)
            if len(chosen) == n:
                break
            free &= x @ x[i] <= apart
    return x[chosen]


def describe(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest pivots of each unit vector, nearest first."""
    near = vectors @ pivots.T
    k = min(k, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


class _Forest:
    """Edges that join the same nodes as all links do, at most n - 1."""

    def __init__(self, n: int):
        self.root, self.edges = list(range(n)), []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        for a, b in zip(rows.tolist(), cols.tolist(), strict=True):
            ra, rb = self._find(a), self._find(b)
            if ra != rb:
                self.root[rb] = ra
                self.edges.append((a, b))


def link(vectors: DataFrame, threshold: float = 0.93, shared: int = 2, nearest: int = 8, n_pivots: int | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``threshold``.

    Returns the key, ``n_links`` (other rows linked directly, copies included), ``component_id`` (smallest key that
    links reach) and ``kept`` (it is the smallest). Defined cases: a vector that is null, empty, zero or holds null or
    non-finite components, and one with a null label, links with nothing; vectors of other length never link;
    a null key counts as a row but names no component; repeated rows link with each other (their key is its own
    component); an empty table gives an empty result; other columns are not read.

    Index: pivots come from SAMPLE distinct vectors in the order of their hash, 4 * sqrt(n) of them, MOST at most.
    Every vector is described by its ``nearest`` pivots and enters the inverted list of each. Two vectors that share
    ``shared`` pivots or more are compared, once, in the list of the first pivot they share. A list over LONG is split by
    the second pivot that they share, as all its pairs share two, unless most of its rows are alike anyway. Equal vectors
    are one class, counted with its size. A list is cut into blocks of BLOCK rows and pairs of blocks are compared as
    matrices, so no list is held by one task and no pair is a row: a pair of blocks returns counts and a forest.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector)
    sound = F.size(v) > 0
    sound = sound & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(sound & F.col(label).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"), sound.alias("sound"))
    classes = cut(rows.where("sound").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("c", F.monotonically_increasing_id()))
    n = classes.count()
    wanted = n_pivots or max(16, min(MOST, round(4 * n**0.5)))
    sample = [r["v"] for r in classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    by_size: dict[int, list] = {}
    for x in sample:
        by_size.setdefault(len(x), []).append(x)
    held = spark.sparkContext.broadcast({size: choose_pivots(xs, wanted) for size, xs in by_size.items()})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["v"].map(len), sort=False):
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    x = units(np.stack(some["v"].to_numpy()))
                    pivots = held.value.get(x.shape[1])
                    near = describe(x, pivots, nearest) if pivots is not None else np.zeros((len(x), 1), np.int64)
                    yield pd.DataFrame({"c": some["c"].to_numpy(), "n": some["n"].to_numpy(), "label": some["label"].to_numpy(), "x": [r.tobytes() for r in x], "size": x.shape[1], "near": list(near.astype(np.int32))})

    kind = classes.schema["label"].dataType.simpleString()
    described = classes.select("c", "n", "label", "v").mapInPandas(index, f"c long, n long, label {kind}, x binary, size int, near array<int>")
    described = cut(described)
    posted = described.withColumn("pivot", F.explode("near"))
    first_of = ["label", "size", "pivot"]
    later = F.filter("near", lambda q: q > F.col("pivot"))
    sizes = posted.groupBy(*first_of).agg(F.count(F.lit(1)).alias("rows"))
    long = cut(sizes.where(F.col("rows") > LONG))
    posted = posted.withColumn("second", F.lit(-1))
    if min(shared, nearest) > 1 and not long.isEmpty():
        pairs = posted.select(*first_of, "near").join(F.broadcast(long), first_of).select(*first_of, "rows", F.explode(later).alias("second"))
        parts = pairs.groupBy(*first_of, "second").agg(F.count(F.lit(1)).alias("part"), F.first("rows").alias("rows"))
        work = parts.groupBy(*first_of).agg(F.sum(F.col("part").cast("double") * F.col("part")).alias("work"), F.first("rows").alias("rows"))
        split = cut(work.where(2 * F.col("work") < F.col("rows").cast("double") * F.col("rows")).select(*first_of, F.lit(True).alias("split")))
        seconds = F.when(F.col("split"), later).otherwise(F.array(F.lit(-1)))
        posted = posted.drop("second").join(F.broadcast(split), first_of, "left").withColumn("second", F.explode(seconds)).drop("split")
    list_of = [*first_of, "second"]
    sizes = posted.groupBy(*list_of).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    # a list of one block compares it with itself; only longer lists copy their rows, once for each block they meet
    block = F.pmod(F.xxhash64("c"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = posted.join(sizes, list_of, "left").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select(*list_of, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "n", "x", "near")

    def compare(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        pivot, second, i, j = k[2], k[3], k[4], k[5]
        b = b.sort_values("c", kind="stable")
        first = (b["block"] == i).to_numpy()
        x = np.frombuffer(b"".join(b["x"]), np.float64).reshape(len(b), int(k[1]))
        near = np.stack(b["near"].to_numpy())
        need = min(shared, near.shape[1])
        names, at = np.unique(near, return_inverse=True)
        has = np.zeros((len(b), len(names)), np.float32)
        has[np.arange(len(b))[:, None], at.reshape(near.shape)] = 1
        left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if i != j else (np.arange(len(b)),) * 2
        lower = (names < pivot) | (names < second) & (names != pivot)  # a pair belongs to the list of the first pivots that it shares
        ids, copies = b["c"].to_numpy(), b["n"].to_numpy()
        count, tree = np.zeros(len(b)), _Forest(len(b))
        their, their_lower, their_x = has[right].T, has[right][:, lower].T, x[right].T
        for start in range(0, len(left) if len(right) else 0, CHUNK):
            some = left[start : start + CHUNK]
            both = has[some] @ their >= need
            if lower.any():
                both &= has[some][:, lower] @ their_lower == 0
            r, c = np.nonzero(both & (x[some] @ their_x >= threshold - 1e-9))
            r, c = some[r], right[c]
            if i == j:
                r, c = r[r < c], c[r < c]
            exact = np.einsum("ij,ij->i", x[r], x[c]) >= threshold
            r, c = r[exact], c[exact]
            count += np.bincount(r, copies[c], len(b)) + np.bincount(c, copies[r], len(b))
            tree.add(r, c)
        hit, edges = np.flatnonzero(count), tree.edges
        return pd.DataFrame({"c": np.r_[ids[hit], ids[[a for a, _ in edges]] if edges else []].astype(np.int64), "m": np.r_[count[hit], np.zeros(len(edges))].astype(np.int64), "to": pd.array([*[None] * len(hit), *[int(ids[z]) for _, z in edges]], dtype="Int64")})

    found = cut(dealt.groupBy(*list_of, "i", "j").applyInPandas(compare, "c long, m long, to long"))
    counts = found.groupBy("c").agg(F.sum("m").alias("m"))
    groups = components(found.where("to is not null"), "c", "to")
    per_class = classes.join(counts, "c", "left").join(groups.withColumnRenamed("node", "c"), "c", "left")
    per_class = per_class.select("label", "v", "id", "n", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("component", "c").alias("component"))
    smallest = per_class.groupBy("component").agg(F.min("id").alias("component_id"))
    done = per_class.join(smallest, "component").select("label", "v", (F.col("n") - 1 + F.col("m")).alias("links"), "component_id")
    sound_rows = rows.where("sound").join(done, ["label", "v"]).select("id", "links", "component_id")
    rest = rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    return sound_rows.unionAll(rest).select(F.col("id").alias(key), F.col("links").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
