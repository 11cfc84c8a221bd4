"""A training corpus from ``documents`` in five stages, each one operator of ``fraygraph.llm``.

Every stage takes (spark, docs, sf_dir) and gets what the stage before kept, reread from Parquet. All but the last return the
columns of ``documents``; the last one encodes, writes and rereads the corpus: (doc_id, start, n_tokens, ids_crc32).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fraygraph.llm import decontaminate, jaccard, mixing, quality, token_output
from fraygraph.session import checkpoint_folder

# Tokenization, hash draws and block files have no SQL twin; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_table(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
    ("token-ID output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet in the shared folder and reread."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
