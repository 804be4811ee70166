"""The changes of a collection are made once, then counted and dealt out."""
from catmatch.operators import activity as act
from catmatch.operators.ranking import running_sum


def test_running_sum_gets_made_changes(spark, monkeypatch):
    seen = []

    def noted(rows, *args):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return running_sum(rows, *args)

    monkeypatch.setattr(act, "running_sum", noted)
    log = spark.createDataFrame([("u", 1, 1, "add", 3), ("u", 2, 2, "remove", 0), ("u", 3, 3, "add", 2), (None, 1, 4, "add", 1)],
                                "u string, ts long, tie long, op string, amount long")
    found = {r.u: (r.quantity, r.status) for r in act.replay_collection(log, ["u"], "ts", "tie", "op", "amount").collect()}
    assert found == {"u": (2, "IN_STOCK"), None: (1, "IN_STOCK")}
    assert len(seen) == 1 and "Join" not in seen[0] and "Aggregate" not in seen[0]
