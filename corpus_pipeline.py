"""A corpus pipeline of five operators; each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtel.llm import packing, secret_scan, simhash, substring, toxicity
from webtel.session import Stages, ship_package


def _recounted(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after` with n_chars, where there is such a column, set to the length of the text."""
    if "n_chars" in after.columns:
        after = after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*before.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay as they are, with columns of any name.

    Null and empty texts score as those without any event and stay; texts of
    any length are read whole; equal texts share their fate.
    """
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, the document with the smallest id stays; rows without an id come last.

    Of repeated rows one stays; null and empty texts are one group.
    """
    ship_package(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 50 that also start in a document with a smaller id go; every document stays.

    Null and short texts, and those of rows without an id, stay as they are.
    """
    ship_package(spark)
    return _recounted(docs, substring.remove_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays. Null and empty texts stay as they are."""
    ship_package(spark)
    return _recounted(docs, secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. Each row, of a null or empty text too, is a document with an end token."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Fingerprints, learned weights and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again.

    What a stage keeps of its own goes once its output is written, and its
    output once the next stage's is. An empty table gives an empty result.
    """
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Stages.released():
            docs = stages.write(stage(spark, docs, sf_dir), name)
        stages.keep_only(name)
    return docs
