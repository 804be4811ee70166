"""Text search with upper bounds against the uncut scores."""
import random

import pytest
from pyspark.sql import functions as F

from catmatch.operators import text_search as ts


WORDS = ["karel", "vintana", "morea", "solis", "brenda", "tarquin", "ostara", "lumen", "celeste", "fervor"]


def _cards(spark, made, n, alike, words=WORDS):
    rows = []
    for i in range(n):
        some = [] if alike else made.sample(words, made.randrange(4))
        rows.append((f"s{made.randrange(10 ** 6):06d}-{i}", " ".join(["common", *some]), f"house{i % 7}", made.choice(["", "merla", "pinora"]),
                     made.choice(["red", "white", ""]), "valley", i % 3 == 0))
    return spark.createDataFrame(rows, "slug string, title string, winery string, grapes string, category string, region string, exact_slug_ambiguity boolean")


@pytest.mark.parametrize("alike, tier_rows, limit", [(False, 4, 3), (True, 4, 3), (False, 1, 1), (True, 10_000, 10)])
def test_cut_search_equals_whole_search(spark, alike, tier_rows, limit):
    made = random.Random(tier_rows + limit)
    cards = _cards(spark, made, 240, alike)
    index = ts.build_index(cards, tier_rows)
    vocabulary = ["common", "karel", "vintana", "morea", "solis", "house1", "house5", "merla", "pinora", "red", "white", "valley", "lumen"]
    lines = [(q, " ".join(["common", *made.sample(vocabulary, made.randrange(5))]), made.choice([0.3, 0.7, 0.95, 1.0])) for q in range(40) for _ in range(2)]
    lines += [(100, "common", 1.0), (101, "common valley", 1.0), (102, "nothing known", 1.0), (103, "karel", 1.0)]
    lines = spark.createDataFrame(lines, "query_id long, text string, confidence double").withColumn("on_target", F.lit(True))
    evidence = ts.query_evidence(lines, index)
    scored = ts.score_profiles(evidence, index)
    expected = ts.expand_members(scored, index, limit).select("query_id", "rank", "slug", "score", "conflicts", "identity_terms")
    for few in (0, 500):  # all queries by their bounds, or those with common terms only
        found = ts.expand_members(ts.best_profiles(evidence, index, limit, few), index, limit).select(*expected.columns)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_a_shared_term_is_not_expanded(spark):
    """All cards and queries share a term; what is scored whole stays within some tiers a query."""
    rare = [a + b for a in ("kar", "vin", "mor", "sol", "bren", "tar", "ost", "lum", "cel", "fer") for b in ("anu", "eki", "ilo", "ofar", "ubin", "yst")]
    cards = _cards(spark, random.Random(1), 1500, False, rare)
    index = ts.build_index(cards, 8)
    lines = spark.createDataFrame([(q, "common " + ("karanu lumofar" if q % 2 else ""), 1.0) for q in range(30)], "query_id long, text string, confidence double")
    lines = lines.withColumn("on_target", F.lit(True))
    evidence = ts.query_evidence(lines, index)
    cut = ts.best_profiles(evidence, index, 5, 0)
    assert index.profiles.count() > 300 and ts.score_profiles(evidence, index).count() == 30 * index.profiles.count()
    assert cut.groupBy("query_id").count().agg(F.max("count")).first()[0] < 0.2 * index.profiles.count()
