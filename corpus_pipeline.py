"""The corpus pipeline: documents in, packed training sequences out.

Quality rules, quality classifier, near-duplicates, packing. Each stage treats all that the one before kept; all but
the last keep the columns of the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import packing, quality_classifier, quality_rules, simhash
from scriptorium.llm.common import prepare, table
from scriptorium.session import checkpoint_folder


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    prepare(spark)
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted good, by what the labels of documents still here teach."""
    prepare(spark)
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"), "doc_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Unlike documents that share an id all stay."""
    prepare(spark)
    return simhash.survivors(docs, "doc_id", width=3, radius=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences of 2,048 tokens."""
    prepare(spark)
    return packing.packed_documents(docs, "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]
#: Learning and packing are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, on the table of documents; what a stage keeps is written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
