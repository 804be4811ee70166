"""Word runs of lines are never the side of a join that is sent to every task."""
import pytest

from catmatch.operators import tagging as tg
from catmatch.sources.tables import lookup

VOCABULARY = "kind string, value string, phrase string, phrase_order int"


@pytest.mark.parametrize("tags", [tg.line_tags, lambda lines, words: tg.find_values(lines, ["query_id", "line_no"], "text", words)])
def test_the_vocabulary_is_sent_not_the_lines(spark, tmp_path, tags):
    spark.createDataFrame([(1, 0, "old red ring")], "query_id long, line_no long, text string").write.parquet(str(tmp_path / "lines"))
    words = [("grapes", f"word{i} {i % 7}", f"word{i} {i % 7}", i) for i in range(3000)] + [("color", "red", "red", 0)]
    spark.createDataFrame(words, VOCABULARY).write.parquet(str(tmp_path / "words"))
    found = tags(spark.read.parquet(str(tmp_path / "lines")), spark.read.parquet(str(tmp_path / "words")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, 0, "color", "red")]


def test_a_large_lookup_is_shuffled(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    joined = spark.range(20).withColumnRenamed("id", "k").join(lookup(rows, most=10), "k")
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 20
