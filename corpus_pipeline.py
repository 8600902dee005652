"""Corpus preparation: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage works on all that its predecessor kept and is written before the next reads it.
Null and empty texts have no words, so the rules drop them; an empty table gives an empty one.
Ids are whole numbers or null. Columns besides those of documents are carried to the last stage,
whatever their names; names must differ from one another.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, mixing, near_dedup, pii, quality_rules
from sparkloom.llm.queries import TOKENIZER
from sparkloom.llm.textkernel import checkpoint, on_one_machine

ORACLE_SQL = None
#: Near copies for the corpus: 5-word Jaccard of 0.80 or more (85 is op7's own contract).
NEAR = near_dedup.Params(percent=80)
#: As few tokens as give every source one whole pass: no document is left out.
MIXTURE = mixing.Params(epochs=None)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest id.

    Rows that repeat an id and its text end as one, the least by value; of an id's different texts all stay,
    if any does. Rows of null id are compared with each other by their whole text only.
    """
    found = checkpoint(near_dedup.near_duplicates(docs, NEAR))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    twice = found.where("kept").groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__twice"))
    own = F.col("doc_id")
    named = docs.where(own.isNotNull()).join(gone, own == F.col("__gone"), "left_anti")
    again = named.join(twice, own == F.col("__twice"), "left_semi").union(docs.where(own.isNull()))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = again.groupBy(own.alias("__id"), F.sha2(F.encode("text", "utf-8"), 256).alias("__text")).agg(F.min(row).alias("__row")).select(*(F.col("__row")[c].alias(c) for c in docs.columns))
    return named.join(twice, own == F.col("__twice"), "left_anti").union(once)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources has them, at least once each."""
    return mixing.mix(docs, MIXTURE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids (packed little-endian 32-bit integers) and the text that they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    return bpe.decode(bpe.encode(docs, path), path)


STAGES = [("quality_rules", rules), ("near_dedup", dedup), ("pii", private), ("mixing", mixed), ("bpe", tokens)]


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not on_one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or "/tmp/checkpoints"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again.

    A stage's folder is removed once the next one is written; the last of them stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        if 0 < i < len(STAGES) - 1:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
