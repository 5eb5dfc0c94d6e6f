"""A corpus pipeline of five stages, each over all that the one before it kept.

Quality rules drop documents, SimHash keeps one document of each near-duplicate group, decontamination drops documents
that leak a benchmark item, the secret scan masks secrets in the text, and the last stage encodes every text in pieces and
checks that they decode to it. All stages but the last return the columns of documents; the last returns the ids.

Defined cases: documents without a text have no words and go in the first stage. Rows without an id, or that repeat one, are
judged each on its own text; of equal rows the second stage keeps one. Very long texts are read whole. Extra columns, whatever
their names, stay up to the last stage. An empty table gives an empty result. Without benchmark items nothing leaks. The
written stages stay in the shared folder, since the result reads the last of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import decontaminate, quality_rules, secret_scan, sentencepiece_codec, simhash
from inkstone.llm.common import shared_folder, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digest(docs, keep_ids=True)


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scan", secrets),
    ("sentencepiece encoding", pieces),
]

#: SQL can express neither the components nor the segmentation; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
