"""The corpus pipeline: rules, repeated lines, near duplicates, personal data, packing.

Each stage takes the documents its predecessor kept and returns them with their columns; the
last returns where the pieces of their token sequences go. A document that the rules reject is
gone, as is one whose lines all stand in earlier documents, and all but the first of a group of
near duplicates. Personal data are replaced by the name of their kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import lines, minhash, packing, pii, repetition
from millrace.llm.words import prepared
from millrace.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return repetition.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return lines.without_repeats(docs, edits=3, least=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return minhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepared(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("personal data", private), ("packing", packed)]

# Suffix arrays, deletion keys and a public tokenizer are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
