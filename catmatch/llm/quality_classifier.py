"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed where the documents are. The trees are grown from a bounded sample of
labelled documents (`SAMPLE`), sent to the executors as arrays, and every row is scored there.
Labels, language, source and id are never inputs.

Defined cases: a null text has the statistics of an empty one and gets a score; without labels
every score is one half, and without labels of both classes their smoothed share; rows that
repeat a doc_id are scored one by one; a null doc_id is kept and not held out; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catmatch.llm import boosting
from catmatch.llm.labelled import labelled_sample

SAMPLE = 20_000
KEEP_FROM = 0.7
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SENTENCE_END = (b".", b"!", b"?")
FEATURES = ["n_words", "word_length", "symbols", "bars", "capitals", "exclamations", "digits", "distinct_words", "doubled_words",
            "distinct_triples", "duplicate_lines", "line_words", "ended_lines", "commas", "short_words", "first_capitals"]


def statistics(text: bytes | None) -> list[float]:
    """The numbers of FEATURES; ratios are per word, letter or line."""
    text = text or b""
    words = text.split()
    n = max(1, len(words))
    letters = max(1, sum(map(len, words)))
    count = lambda characters: len(text) - len(text.translate(None, characters))
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_lines = max(1, len(lines))
    return [np.log1p(len(words)), letters / n, count(b"#*$%&<>") / n, count(b"|") / n, count(_UPPER) / letters, count(b"!") / n,
            count(_DIGITS) / letters, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2), 1 - len(set(lines)) / n_lines,
            np.log1p(n / n_lines), sum(line.rstrip().endswith(_SENTENCE_END) for line in lines) / n_lines, count(b",") / n,
            sum(len(w) <= 3 for w in words) / n, sum(w[:1].isupper() for w in words) / n]


def _features(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(text) for text in texts], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, among: Column | None = None) -> boosting.Forest:
    """Trees from at most `sample` labelled documents; `among` restricts the labels."""
    chosen = labelled_sample(docs, labels, sample, among).select("doc_id", F.col("text").cast("binary"), "quality")

    def measure(batches):
        for batch in batches:
            x = _features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"])

    # At most `sample` rows: a labelled id that rows repeat is one document, the one with the smallest statistics.
    rows = (chosen.mapInArrow(measure, "doc_id long, x array<double>, y int").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
            .orderBy("y", "x").select("x", "y").toArrow().combine_chunks())
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return boosting.fit(x, rows.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, forest: boosting.Forest) -> DataFrame:
    """doc_id, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def rate(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_features(batch.column(1).to_pylist())))],
                                             names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(rate, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels of documents that are not held out."""
    forest = fit(docs, labels, sample, ~held_out(F.col("doc_id")))
    return score(docs, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
