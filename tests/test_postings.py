"""Pairs of queries and cards are counted where they arise."""
import re

from catmatch.plans import QUERIES


def test_pairs_of_term_postings_are_not_shuffled(spark):
    found = QUERIES["term_postings"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, profile#", plan) and "BroadcastHashJoin" in plan
    assert found.count() == found.select("query_id", "slug").distinct().count() > 0
