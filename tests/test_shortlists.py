"""Decision queries make their shortlist once, however often they read it."""
import pytest

from catmatch.plans import decision_queries as dq
from catmatch.sources.bindings import Views


@pytest.mark.parametrize("name", ["membership_features", "refuse_unknown", "score_candidates", "finalize"])
def test_shortlists_are_made_once(spark, monkeypatch, name):
    made = Views.candidates.fget
    calls = []
    monkeypatch.setattr(Views, "candidates", property(lambda v: calls.append(1) or made(v)))
    rows = getattr(dq, name)(Views(spark, "/root/testdata/sf0.001"))
    assert rows.count() > 0 and len(calls) == 1
    assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString()
