"""Mixing sends a text to its task once and judges few rows at a time."""
import re
from collections import Counter

from catmatch.llm import mixing


def test_texts_travel_once_and_pieces_keep_every_row(spark, documents):
    docs = documents([(i, f"word{i % 7} other{i % 3} words") for i in range(3 * mixing.BATCH_ROWS // 2)] + [(9_999, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mixed = mixing.mix_documents(docs, labels)
    assert re.search(r"MapInArrow judge\(row#\d+\)", mixed._jdf.queryExecution().optimizedPlan().toString())
    assert Counter(mixed.collect()) == Counter(docs.collect())  # without labels all stay
    assert mixing.mixture(docs, labels).count() == docs.count()
