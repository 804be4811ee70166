"""Ranks, running sums and triggers of hot keys: buckets stay small, nulls keep their rows."""
import random

import pytest
from pyspark.sql import functions as F

from catmatch.operators import activity as act
from catmatch.operators import ranking as rk

CASES = {"one outlier": lambda i: 1e12 if i == 0 else i % 50 / 50, "all equal": lambda i: 7.0, "all null": lambda i: None,
         "mixed": lambda i: None if i % 3 == 0 else float(i % 11)}


def _rows(case, n=2000):
    made = random.Random(n)
    keys = [1] * 9 + [2, None]
    return [(made.choice(keys), f"k{i:05d}", CASES[case](i), i % 7) for i in range(n)]


@pytest.mark.parametrize("case", sorted(CASES))
def test_ranks_and_sums(spark, case):
    data = _rows(case)
    rows = spark.createDataFrame(data, "q int, k string, s double, n long")
    buckets = rk.with_buckets(rows, ["q"], [F.col("s").desc_nulls_last(), F.col("k")], 100)
    assert buckets.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 400
    ranked = {r["k"]: r["rank"] for r in rk.rank_candidates(rows, "q", "s", "k", rows_per_bucket=100).collect()}
    summed = {r["k"]: r["total"] for r in rk.running_sum(rows, ["q"], ["s", "k"], "n", "total", 100).collect()}
    for key in (1, 2, None):
        mine = [r for r in data if r[0] == key]
        falling = sorted(mine, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        assert [ranked[r[1]] for r in falling] == list(range(1, len(mine) + 1))
        total = 0
        for row in sorted(mine, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
            total += row[3]
            assert summed[row[1]] == total
    assert len(ranked) == len(summed) == len(data)


def test_equal_rows_are_split(spark):
    rows = spark.range(1000).select(F.lit(None).cast("int").alias("q"), F.lit(1.0).alias("s"), F.lit("x").alias("k"))
    assert rk.with_buckets(rows, ["q"], [F.col("s"), F.col("k")], 100).groupBy("_bucket").count().agg(F.max("count")).first()[0] < 300
    assert sorted(r["rank"] for r in rk.rank_candidates(rows, "q", "s", "k", 100).collect()) == list(range(1, 1001))


def test_collection_log_of_one_hot_key(spark):
    made = random.Random(3)
    log = [(None if i % 2 else 1, i, i, made.choice(["add", "set", "in_stock", "consumed"]), made.randrange(4)) for i in range(600)]
    rows = spark.createDataFrame(log, "u int, ts long, tie long, op string, amount int")
    state = {}
    for u, _, _, op, n in log:
        q = state.get(u)
        if q is None and op != "add":
            continue  # it does not exist yet
        q = q or 0
        state[u] = {"add": max(0, q + n), "set": n, "in_stock": max(1, q), "consumed": q}[op]
    found = {r["u"]: r["quantity"] for r in act.replay_collection(rows, ["u"], "ts", "tie", "op", "amount", 50).collect()}
    assert found == state and set(found) == {1, None}
