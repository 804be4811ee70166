"""Founding words that prose holds by chance."""
from catmatch.plans import QUERIES


def test_year_candidates_takes_founding_from_the_tail_alone(spark, tmp_path):
    text = "none\nthe ofounded house\nsince the Establishment"
    spark.createDataFrame([(36, text)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["year_candidates"](spark, str(tmp_path)).collect()
    assert {r["line_no"]: r["years"] for r in found} == {0: "", 1: "1936", 2: "1936"}
