"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: that of ``spark.checkpoint.dir``, or one of our own where a local session names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmine-checkpoint-"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder by the file system that Spark reads it with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a driver lives on long after a model is fitted on it."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def clean(spark: SparkSession) -> None:
    """Delete this application's checkpoints. Results that were not written before cannot be read afterwards."""
    if (folder := spark.sparkContext.getCheckpointDir()) is not None:
        delete(spark, folder)
        spark.sparkContext.setCheckpointDir(folder.rsplit("/", 1)[0])


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    A checkpoint also keeps the constraints of its plan, which multiply in a loop until planning takes longer than
    running; so none are inferred here.
    """
    shared_folder(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(name, before)


#: So many edges are few enough for one task (a few MB).
FEW = 100_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, rep) of every node of these edges, by union-find."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root[find(y)] = find(x)
    if kind is not None:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["v", "rep"])


def components(edges: DataFrame, a: str, b: str, native: bool = False) -> DataFrame:
    """Connected components by randomised contraction, as (node, component).

    ``component`` is the smallest node of the component; only nodes that occur in an edge between
    two different nodes are returned. Null ends, loops and repeated edges are ignored.

    Each round every node points to the neighbour (or itself) of the smallest salted hash, and the
    edges are rewritten onto these representatives. The salt makes paths and stars contract alike,
    so the number of rounds grows with the logarithm of the nodes. Minimums and distincts combine
    before the shuffle, so that a hub node costs one row a task; the joins are against a table with
    one row a node, whose other side Spark may split. Nothing but a row count reaches the driver. The last FEW
    edges are united by one task, unless ``native`` asks for DataFrame functions throughout.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    left = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while n := left.count():
        if n <= FEW and not native:
            ship(left.sparkSession)
            kind = left.schema["a"].dataType.simpleString()
            steps.append(cut(left.coalesce(1).mapInArrow(_united, f"v {kind}, rep {kind}")))
            break
        salt = F.lit(len(steps))
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(salt, c).alias("h"), F.col(c).alias("n"))
        step = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["n"].alias("rep")))
        steps.append(step)
        at = lambda c: step.select(F.col("v").alias(c), F.col("rep").alias(f"r{c}"))  # noqa: E731,B023
        left = cut(left.join(at("a"), "a").join(at("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = steps[0].select(F.col("v").alias("node"), "rep")
    for step in steps[1:]:
        nodes = nodes.join(step.select(F.col("v").alias("rep"), F.col("rep").alias("next")), "rep", "left").select("node", F.coalesce("next", "rep").alias("rep"))
    nodes = cut(nodes)
    smallest = nodes.groupBy("rep").agg(F.min("node").alias("component"))
    return nodes.join(smallest, "rep").select("node", "component")
