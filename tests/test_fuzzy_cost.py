"""What a distinct word costs: its keys, and how often it is read and measured."""
import random

from pyspark.sql import functions as F

from catmatch.functions.distance import damerau_distance, small_distance
from catmatch.operators.fuzzy import term_keys, term_matches, word_keys
from catmatch.operators.text_search import producer_matches


def test_keys_of_a_word_do_not_grow_with_its_length(spark):
    words = ["abcdefghij"[:n % 10] + "klmnopqrstuvwxyz"[:n - n % 10] for n in range(6, 21)]
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, budget int")
    assert word_keys(rows).groupBy("word").count().agg(F.max("count")).first()[0] <= 37
    terms = term_keys(spark.createDataFrame([(w,) for w in words], "term string"))
    assert terms.groupBy("term").count().agg(F.max("count")).first()[0] <= 37


def test_pairs_are_measured_once_and_readings_made_once(spark):
    words = spark.createDataFrame([("keepsake",), ("kepesake",), ("other",)], "word string")
    terms = spark.createDataFrame([("keepsake",), ("keepsakes",), ("others",)], "term string")
    found = term_matches(words, terms)
    assert {(r.raw, r.term) for r in found.collect()} == {
        ("keepsake", "keepsake"), ("kepesake", "keepsake"), ("other", "others")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("array_contains(") == 1


def test_small_distance_of_long_words_with_swaps(spark):
    made = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(made.choice("abcdef") for _ in range(made.randint(6, 14)))
        b = a
        for _ in range(made.randint(1, 3)):
            i, kind = made.randrange(len(b) - 1), made.randrange(4)
            b = [b[:i] + b[i + 1] + b[i] + b[i + 2:], b[:i] + b[i + 1:], b[:i] + made.choice("abcdefg") + b[i:],
                 b[:i] + made.choice("abcdefg") + b[i + 1:]][kind]
        pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("d", small_distance(F.col("a"), F.col("b")))
    for r in rows.collect():
        exact = damerau_distance(r.a, r.b)
        assert r.d == (exact if exact <= 2 else None)


def test_producers_read_every_word_once(spark):
    words = spark.createDataFrame([("sunnyvalley",), ("sunnyvaley",), ("other",)], "word string")
    owners = spark.createDataFrame([("sunnyvalley", "Sunny Valley"), ("moonvalley", "Moon")], "term string, winery string")
    found = producer_matches(words, owners)
    assert {(r.raw, r.winery) for r in found.collect()} == {("sunnyvalley", "Sunny Valley"), ("sunnyvaley", "Sunny Valley")}
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
