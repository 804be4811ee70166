"""The operators over their whole tables, as registered queries with the SQL that states their results."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catmatch.llm import (chat, html_text, mixing, ngram_join, packing, quality_classifier, quality_rules, resampling, spelling,
                          substring, topk_search, url_rules, warc)
from catmatch.llm.common import shared_folder, table
from catmatch.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.CLOSE}{chat.OPEN}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(turns.unionByName(extra))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(spark, table(spark, sf_dir, "pages"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines",
                         "stats.n_repeat_words", "base_failed", "kept", "good")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written at the call and read back by the frame it returns; they stay in the shared folder."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder, key="page_id")
    records = warc.read_archives(spark, folder, payloads=False).filter("gap is null")
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


@query
def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), slip_every=97)


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
