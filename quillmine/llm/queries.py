"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillmine.llm import bpe, kneser_ney, langid, latent, minhash, pivots, sharding, toxicity, urls, warc
from quillmine.llm.common import table

RULES = (urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/"))


def op1_warc_revisits(spark, sf_dir):
    done = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    return done.withColumn("headers", fields)


def op2_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op3_pivot_index(spark, sf_dir):
    return pivots.link(table(spark, sf_dir, "embeddings"))


def op4_compression_toxicity(spark, sf_dir):
    done = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("toxic_score")
    return done.select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op5_weighted_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_latent_decontamination(spark, sf_dir):
    return latent.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark, sf_dir):
    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language_id(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out("doc_id", 4, 2)
    done = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where(~out)))
    return done.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_rendezvous_sharding(spark, sf_dir):
    return sharding.rendezvous(table(spark, sf_dir, "documents"), [1.0] * 24)


def op10_kneser_ney_quality(spark, sf_dir):
    done = kneser_ney.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "lang", "perplexity", "threshold", "good")


QUERIES = {
    f.__name__: f
    for f in (op1_warc_revisits, op2_url_filters, op3_pivot_index, op4_compression_toxicity, op5_weighted_minhash, op6_latent_decontamination, op7_byte_bpe, op8_rendezvous_sharding, op9_language_id, op10_kneser_ney_quality)
}
