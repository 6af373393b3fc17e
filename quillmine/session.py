"""What Python workers need of the driver's session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch's values that a worker turns into Python objects at a time.
PART_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quillmine-"), "quillmine.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def portions(values: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Start and end of portions of texts or bytes, in order, of about ``most`` bytes (one value at least)."""
    if pa.types.is_null(values.type):
        values = values.cast(pa.binary())
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(values):
        yield at, len(values)
