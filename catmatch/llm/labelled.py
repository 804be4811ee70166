"""A bounded, repeatable sample of labelled documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, among: Column | None = None) -> DataFrame:
    """doc_id, text, quality, toxic of at most `most` labelled documents, the first in hash order.

    Several labels of one document count as its worst. The sample of ids is bounded, so it is
    broadcast, and no text is shuffled. Labels without id or quality are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if among is not None:
        known = known.filter(among)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"),
                                        F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
