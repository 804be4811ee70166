"""Missing terms: only the heaviest terms of a query meet its cards, and none is lost by that."""
import random
from types import SimpleNamespace

from catmatch.operators.text_search import missing_terms


def test_long_queries_are_cut_before_they_meet_their_cards(spark):
    made = random.Random(5)
    terms = [f"t{i}" for i in range(60)]
    idf = {t: 1 + i // 4 for i, t in enumerate(terms)}
    cards = {"a": set(terms[-9:]), "b": set(made.sample(terms, 5)), "c": set()}
    asked = {q: {t: made.choice([0.5, 1.0]) for t in made.sample(terms, 50)} for q in (1, 2)}
    index = SimpleNamespace(
        vocabulary=spark.createDataFrame(list(idf.items()), "term string, idf int"),
        weights=spark.createDataFrame([(c, t) for c, ts in cards.items() for t in ts], "profile string, term string"))
    evidence = spark.createDataFrame([(q, t, s) for q, ts in asked.items() for t, s in ts.items()], "query_id int, term string, strength double")
    candidates = spark.createDataFrame([(q, "s" + c, c) for q in asked for c in cards], "query_id int, slug string, profile string")
    found = missing_terms(candidates, evidence, index, 4)
    expected = {(q, "s" + c, t) for q, ts in asked.items() for c, own in cards.items()
                for t in sorted(set(ts) - own, key=lambda t: (-idf[t] * ts[t], t))[:4]}
    assert {(r.query_id, r.slug, r.term) for r in found.collect()} == expected
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Window [") == 2
