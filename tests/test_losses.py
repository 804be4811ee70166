"""Rows and phrases that must not vanish."""
from pyspark.sql import functions as F

from catmatch.operators import ranking as rk
from catmatch.operators import tagging as tg


def test_null_scores_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", None), (1, "c", 5.0)], "q int, k string, s double")
    ranked = {r["k"]: r["rank"] for r in rk.rank_candidates(rows, "q", "s", "k", rows_per_bucket=1).collect()}
    assert ranked == {"c": 1, "a": 2, "b": 3}
    summed = {r["k"]: r["total"] for r in rk.running_sum(rows.withColumn("n", F.lit(1)), ["q"], ["s", "k"], "n", "total", 1).collect()}
    assert summed == {"b": 1, "a": 2, "c": 3}


def test_long_phrases_are_found(spark):
    vocabulary = tg.phrase_table(spark, "name", {"one two three four": [], "one two three four five six": []})
    lines = spark.createDataFrame([(1, "say one two three four five six now")], "id int, text string")
    assert [r["value"] for r in tg.find_values(lines, ["id"], "text", vocabulary).collect()] == ["one two three four five six"]


def test_pages_are_as_long_as_asked(spark):
    assert rk.page(spark.range(700), ["id"], 1, 500).count() == 500
    assert rk.page(spark.range(700), ["id"], 2, 500).filter("position > 500").count() == 200
