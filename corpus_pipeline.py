"""The training-data pipeline: each stage calls one operator on what its
predecessor kept, is written as Parquet and read again.

    toxicity               documents with a score of 0.7 or more go
    simhash_dedup          one document of each group of near copies stays
    decontamination        documents that hold a benchmark item go
    mixing                 documents are chosen to the target weights
    token_ids              what is left is written as token blocks and read back
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opslens.llm.common import read_table, stage
from opslens.llm.decontaminate import without_benchmark
from opslens.llm.mixing import mixed_documents
from opslens.llm.queries import MIX, tokenizer_path
from opslens.llm.simhash import simhash_dedup
from opslens.llm.tokenfile import token_ids
from opslens.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, weights=MIX)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", write_tokens),
]

#: no SQL for a trained classifier or a hash of shingles; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, f"pipeline-{name}")
    return docs
