"""Where the postings are sent, a query's cards and terms meet in its task."""
import re

import pytest

from catmatch.plans import QUERIES


@pytest.mark.parametrize("name", ["text_evidence", "missing_terms"])
def test_pairs_are_not_shuffled(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"query_id#\d+L?", k) for k in keys)
