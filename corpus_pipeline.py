"""From raw documents to packed token sequences: the stages of the pipeline, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusweave.llm import byte_cnn, near_copies, packing, rules
from corpusweave.llm.queries import TOKENIZER, table
from corpusweave.session import new_table_path

#: Words that packing remembers: Python workers outlive their stages, so its memory stands beside what the earlier ones left.
REMEMBERED = 1 << 16


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network takes for good ones."""
    return byte_cnn.accepted(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    return rules.without_failures(docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 or more of their 5-word shingles the one with the smallest id."""
    return near_copies.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, as pieces of documents."""
    return packing.pack(docs, TOKENIZER, remembered=REMEMBERED)


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("SimHash near-dedup", remove_copies), ("packing", pack)]

#: Neither the network, XXH64 nor the tokenizer exist in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
