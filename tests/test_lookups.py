"""Searches for many needles, and facts as of an event, against brute force."""
import random

from pyspark.sql import functions as F

from catmatch.operators import catalog as cat
from catmatch.operators import ranking as rk


def test_many_needles(spark):
    made = random.Random(2)
    cards = [(f"s{i:03d}", "".join(made.choice("abÄß \n") for _ in range(made.randrange(12))) if i % 9 else None, made.choice(["Red", None])) for i in range(120)]
    needles = [(i, "".join(made.choice("abÄß R") for _ in range(made.randrange(6)))) for i in range(300)] + [(900, None), (901, "  "), (902, "zzz"), (903, "RED"), (903, "red ")]
    index = cat.substring_index(spark.createDataFrame(cards, "slug string, title string, winery string"), ["slug", "title", "winery"])
    found = cat.search_many(index, spark.createDataFrame(needles, "needle_id int, needle string"), 4)
    fold = lambda t: t.lower().replace("ß", "ss")
    expected = []
    for number, needle in needles:
        hits = sorted(s for s, t, w in cards if fold((needle or "").strip(" ")) in fold(f"{s} {t or ''} {w or ''}"))
        expected += [(number, s, n + 1) for n, s in enumerate(hits[:4])]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_last_fact_of_hot_and_missing_keys(spark):
    made = random.Random(4)
    keys = [7] * 8 + [1, None]
    events = [(made.choice(keys), made.randrange(500), i) for i in range(600)] + [(7, None, 600), (99, 5, 601)]
    facts = [(made.choice(keys), made.randrange(500), i) for i in range(300)] + [(7, None, 300)]
    for within in (None, 3):
        found = rk.asof_last(spark.createDataFrame(events, "w int, ts int, e int"), spark.createDataFrame(facts, "w int, ts int, beat int"), ["w"], "ts", within, 50)
        rows = {(r["w"], r["ts"], r["e"], r["last"] and r["last"]["beat"]) for r in found.collect()}
        expected = set()
        for w, ts, e in events:
            past = [(t, b) for k, t, b in facts if k == w and ts is not None and t is not None and t <= ts and (within is None or ts - t <= within)]
            expected.add((w, ts, e, max(past)[1] if past else None))
        assert rows == expected
    assert rk.asof_last(spark.createDataFrame(events, "w int, ts int, e int"), spark.createDataFrame([], "w int, ts int, beat int"), ["w"], "ts").filter(
        F.col("last").isNotNull()).count() == 0
