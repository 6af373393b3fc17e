"""Tables as versioned folders of Parquet: a change writes the next version beside the last, so readers never see half of one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Versions of a table that stay.
KEPT = 2


class Store:
    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], namespace: str | None = None):
        self.spark, self.schemas = spark, schemas
        self.folder = f"{folder.rstrip('/')}/{namespace}" if namespace else folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        """The complete versions, by the marker that Spark's writer leaves last; any file system that Spark reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().isdigit()]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        schema = self.spark.createDataFrame([], self.schemas[name]).schema
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], StructType(schema.fields))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{versions[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Make ``df`` the table; it may read the table itself."""
        versions = self._versions(name)
        at = versions[-1] + 1 if versions else 0
        schema = self.spark.createDataFrame([], self.schemas[name]).schema
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(f"{self.folder}/{name}/{at}")
        for old in versions[: max(0, len(versions) + 1 - KEPT)]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to the newest version without reading it; rows that others add meanwhile stay."""
        versions = self._versions(name)
        if not versions:
            self.write(name, df)
            return
        schema = self.spark.createDataFrame([], self.schemas[name]).schema
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}/{versions[-1]}")

    @contextmanager
    def kept(self, df: DataFrame) -> Iterator[DataFrame]:
        """These rows written once, for plans that read them more than once; deleted at the end."""
        folder = f"{self.folder}/.{uuid.uuid4()}"
        df.write.parquet(folder)
        try:
            yield self.spark.read.schema(df.schema).parquet(folder)
        finally:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
