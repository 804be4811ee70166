"""The corpus pipeline: documents through the operators of catmatch.llm, stage by stage.

Quality rules drop documents, the n-gram Jaccard join keeps one of each group of near copies,
substring deduplication cuts repeated passages out of texts, mixing repeats or drops documents
to the target weights, and best-fit packing lays what is left out in sequences. All stages but
the last return the columns of documents. `run` writes every stage as Parquet in the shared
folder of spark.checkpoint.dir and reads it again, so a lost executor never costs a stage.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catmatch.llm import mixing, ngram_join, packing, quality_rules, substring
from catmatch.llm.common import shared_folder, table

#: A scarce domain is repeated so often at most.
MOST_REPEATS = 4.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"), most_rate=MOST_REPEATS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages),
    ("mixing", target_weights), ("best_fit_packing", packed)]
#: Weak supervision, the classifier and the packer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
