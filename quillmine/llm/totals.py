"""Sums of fixed arrays over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import ship

#: Numbers of one chunk, and tasks whose chunks are summed in one step.
CHUNK, MOST = 1 << 16, 64


def total(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int, dtype: str = "int64") -> np.ndarray:
    """The sum of ``part`` of every task's rows, an array of ``size`` numbers (zeros without rows).

    Tasks return chunks, which are summed in two steps if there are many tasks, so that no group grows with their
    number, and the driver gets ``size`` numbers.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = part(batches)
        if got is not None:
            flat = np.ascontiguousarray(got, dtype).ravel()
            for i in range(0, size, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([flat[i : i + CHUNK].tobytes()], pa.binary())], ["at", "sums"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": g["at"].iloc[:1], "sums": [sum(np.frombuffer(x, dtype) for x in g["sums"]).tobytes()]})

    kind = "at int, sums binary"
    sc = rows.sparkSession.sparkContext
    known = sc.getConf().get("spark.dynamicAllocation.enabled", "false") != "true"
    if known:  # every task sends a whole array, so two waves of them are enough
        rows = rows.coalesce(2 * sc.defaultParallelism)
    parts = rows.mapInArrow(run, kind)
    if not known or 2 * sc.defaultParallelism > MOST:
        parts = parts.withColumn("salt", F.spark_partition_id() % F.lit(MOST)).groupBy("at", "salt").applyInPandas(add, kind)
    parts = parts.groupBy("at").applyInPandas(add, kind)
    out = np.zeros(size, dtype)
    for r in parts.toLocalIterator():
        piece = np.frombuffer(r["sums"], dtype)
        out[r["at"] : r["at"] + len(piece)] = piece
    return out
