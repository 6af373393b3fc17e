"""Clean a corpus: five stages over ``documents``, each a thin use of an operator of quillmine.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
A row is known by its doc_id and a hash of its text, so that rows that share a doc_id, or have none, are judged each by
its own text. Labels go by doc_id alone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import bpe, kneser_ney, latent, minhash
from quillmine.llm import toxicity as tox
from quillmine.llm.common import cut, delete, shared_folder, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return tox.score(docs, table(spark, sf_dir, "labels")).where("toxic_score < 0.5").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return kneser_ney.classify(docs, table(spark, sf_dir, "labels")).where("good").select(*docs.columns)


#: The name of a column that tells rows apart, for as long as a stage runs.
ROW = "row of the corpus"


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.struct("doc_id", F.xxhash64("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id; one of rows that repeat id and text."""
    named = _named(docs)
    rest = minhash.near_duplicates(named, key=ROW).where("not kept").select(ROW).distinct()
    left = named.join(rest, ROW, "left_anti")
    repeated = cut(named.where("trim(text) <> ''").groupBy(ROW).count().where("count > 1").select(ROW))
    if not repeated.isEmpty():
        left = left.join(repeated, ROW, "left_anti").unionByName(left.join(repeated, ROW, "left_semi").dropDuplicates([ROW]))
    return left.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    named = _named(docs)
    leaks = latent.contaminated(named, table(spark, sf_dir, "benchmark"), key=ROW).select(ROW).distinct()
    return named.join(leaks, ROW, "left_anti").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of what they decode to."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: Trained models and sketches are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written once to the shared folder, as later stages read it more than once, and
    deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                delete(spark, f"{folder}/{i - 1}")
    return docs
