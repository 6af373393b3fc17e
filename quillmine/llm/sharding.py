"""Operator 8: rendezvous hashing of stable record keys over weighted shards (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import cut

#: Parts of a shard that are numbered on their own; with the number of shards it bounds the table of offsets.
PARTS = 1024


def _hashed(key: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float) -> Column:
    """weight / -ln(u) of a u in (0, 1) that the key and the shard decide: the largest score wins a share in proportion to the weight."""
    u = (_hashed(F.concat(key, F.lit(f":{shard}")), 12) + F.lit(0.5)) / F.lit(float(2**48))
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal records to shards 0 .. len(weights)-1 by highest random weight.

    Returns the key, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``law`` ("key"), ``shard``, ``slot``
    (gapless from 0 in a shard) and ``grown_shard`` (with one more shard, of ``grown_weight``). The key
    and the shards alone decide: a new shard only takes rows, and equal keys share a shard.

    Defined cases: a null key hashes as the empty string; a null text has size 8 and CRC 0; repeated
    rows each get a slot of their own; an empty table gives an empty result; other columns are not read.

    Slots: a shard is cut into PARTS by a hash of key, CRC and size, parts are numbered by a window and
    shifted by the running count of earlier parts. No task sorts a whole shard, and the offsets that are
    joined are len(weights) x PARTS rows at most. Rows that repeat key and text are one part's, in any order.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    dealt = docs.select(
        F.col(key).alias("k"), name.alias("name"),
        (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.array_max(F.array(*[F.struct(_score(name, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)])).alias("best"),
    )
    n = len(weights)
    dealt = dealt.select(
        "k", "size", "text_crc32", (-F.col("best.i")).cast("int").alias("shard"),
        F.when(_score(F.col("name"), n, grown_weight) > F.col("best.s"), F.lit(n)).otherwise(-F.col("best.i")).cast("int").alias("grown_shard"),
        F.pmod(_hashed(F.concat_ws(":", "name", "text_crc32", "size"), 8), F.lit(PARTS)).cast("int").alias("part"),
    )
    dealt = cut(dealt)  # numbers instead of texts, read twice below
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("k", "text_crc32", "size")
    numbered = dealt.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "grown_shard"
    )
