"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, licenses, lm_score, mixing, near_dedup, pii, quality_fm, quality_rules, sharding

#: The tokenizer that op1 and the pipeline use.
TOKENIZER = "byte_bpe_50k.json"
#: op6: as many tokens as the corpus has, dealt so that the mixture has nine tenths of the largest entropy (three repeats at most).
MIXTURE = mixing.Params(entropy=0.9, repeats=3.0, epochs=1.0)
#: Bytes that a shard of op8 may have.
SHARD_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return bpe.digests(bpe.decode(bpe.encode(documents(spark, sf_dir), path), path))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir)).select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("score", 4).alias("score"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(documents(spark, sf_dir))
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    firsts = F.transform(base, lambda d: d["first"])
    doubt = F.aggregate("detections", F.lit(1.0), lambda acc, d: acc * (1 - d["weight"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        (1 - doubt).alias("score"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts(pii.find_pii(documents(spark, sf_dir)))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir), MIXTURE).select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "copies", "block", "at")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARD_BYTES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("dup_line_chars", "repeat_chars")


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2
    docs = documents(spark, sf_dir)
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_fm.Params(meta=("n_chars",)), where=~held_out("doc_id"))
    return quality_fm.score(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_lm_score, op3_licenses, op4_pii, op5_ann, op6_mixing, op7_near_dedup, op8_sharding, op9_quality_rules, op10_quality_fm)}
