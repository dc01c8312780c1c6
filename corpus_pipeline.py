"""A corpus from documents to token files, stage by stage.

Each stage takes what its predecessor kept. The first four return rows of ``documents`` with all their
columns: quality rules drop what they reject, near-duplicate classes keep one document each,
contaminated documents go, and the mix returns each row as often as it takes it. The last encodes what
is left and returns what the token files say of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumaframe.llm import decontamination, minhash, mixing, quality_rules, token_files
from lumaframe.llm.common import shared_path, table
from lumaframe.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.filter_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token files", tokens),
]

#: Near-duplicate classes, the fitted mix and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = shared_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}")
        docs = spark.read.parquet(f"{place}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
