"""Evidence that is read once is neither written nor shuffled again, and scores are those of evidence that is kept."""
from catmatch.operators import text_search as ts


def shuffles(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_text_of_a_query_is_shuffled_once(spark):
    cards = spark.createDataFrame([(f"c{i}", f"alpha{i % 3} stone river", f"house{i % 5}", "merlot", "red", "north") for i in range(12)],
                                  "slug string, title string, winery string, grapes string, category string, region string")
    lines = spark.createDataFrame([(q, n, f"alpha{q % 3} stane house{q % 5} merlot red", 0.9, True) for q in range(20) for n in range(2)],
                                  "query_id long, line_no int, text string, confidence double, on_target boolean")
    index = ts.build_index(cards)
    kept = ts.query_evidence(lines, index)
    once = ts.query_evidence(lines, index, once=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, kept.collect())) and kept.count() > 20
    scored = ts.score_profiles(once, index)
    assert shuffles(scored) == 1  # the lines of a query meet; all else follows there
    assert sorted(map(str, scored.collect())) == sorted(map(str, ts.score_profiles(kept, index).collect())) and scored.count() > 20
