"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go, then those that fail the quality rules, then all but one of each near-duplicate group; personal data
is sanitised; what remains is packed into sequences. Its result can't be said in SQL (see tests/llm).

Edge cases follow from the operators: a null or empty text isn't toxic, fails the quality rules (it has fewer than ten words) and so
goes in the second stage; a null doc_id can have no label and is else a row like any other. Repeated rows and equal texts
are one group, of which one row stays: the smallest doc_id, and one of the rows that share it. Very long texts are read whole. Without labels of
both classes no document is toxic. Columns beyond those of documents, whatever their names, are kept by all stages but the
last. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscore.llm import packing, pii, quality, shared, simhash, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("pii", stage_pii),
    ("packing", stage_packing),
]

#: Neither the model, zstandard nor XXH64 can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        point = shared.mark()
        after, path = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}", point)
        if before:
            shared.discard(spark, before)
        docs, before = after, path
    return docs
