"""Fuzzy matching against brute force over small vocabularies."""
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from catmatch.functions.distance import damerau_distance, damerau_levenshtein, deletions, small_distance, with_deletion_keys
from catmatch.operators.fuzzy import close_terms, edit_limit, term_matches, variants_of


def random_words(n, letters, low, high, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)})


def limit_of(word):
    return 0 if len(word) <= 3 or word.isdigit() else 1 if len(word) <= 5 else 2


def test_distance_known_values():
    assert damerau_distance("ca", "abc") == 2
    assert damerau_distance("abcd", "abdc") == 1
    assert damerau_distance("", "abc") == 3


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_words_within_two_edits_share_a_deletion_key(left, right):
    d = damerau_distance(left, right)
    if d <= 2:
        assert deletions(left, d) & deletions(right, 2)


def test_small_distance_equals_the_exact_one(spark):
    words = random_words(80, "abc", 1, 7, 1)
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    rows = pairs.select("a", "b", small_distance(F.col("a"), F.col("b")).alias("d"),
                        damerau_levenshtein("a", "b").alias("exact")).collect()
    for r in rows:
        exact = damerau_distance(r.a, r.b)
        assert r.exact == exact
        assert r.d == (exact if exact <= 2 else None)


def brute(words, terms, per_word=4):
    out = set()
    for w in words:
        near = sorted((damerau_distance(w, t), t) for t in terms)
        out |= {(w, t, d) for d, t in [x for x in near if x[0] <= limit_of(w)][:per_word]}
    return out


def test_close_terms_equals_brute_force(spark):
    terms = random_words(150, "abcd", 3, 9, 2)
    words = random_words(150, "abcd", 2, 9, 3) + terms[::7]
    # Long words go through the segment keys; edit a few of them.
    long = ["".join(random.Random(i).choice("abcdefgh") for _ in range(20 + i % 8)) for i in range(30)]
    edited = [w[:5] + w[6] + w[5] + w[7:-1] for w in long] + [w[:9] + "zz" + w[9:] for w in long] + [w[1:-1] for w in long]
    terms, words = terms + long, sorted(set(words + edited + long))
    found = close_terms(spark.createDataFrame([(w,) for w in words], "word string"),
                        spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.word, r.term, r.distance) for r in found.collect()} == brute(words, terms)


def test_keys_made_in_spark_are_all_deletions(spark):
    rows = [(w, b) for w in ["", "a", "ab", "aab", "äöü", "abcdef", "mississippi"] for b in (0, 1, 2)]
    found = with_deletion_keys(spark.createDataFrame(rows, "w string, b int"), "w", "b").distinct().collect()
    assert {(r.w, r.b, r.key) for r in found} == {(w, b, k) for w, b in rows for k in deletions(w, b)}


def test_words_of_all_lengths_meet_and_no_python_runs(spark, capsys):
    made = random.Random(9)
    terms = sorted({"".join(made.choice("abcde") for _ in range(n)) for n in range(2, 41) for _ in range(3)})
    words = set(terms)
    for t in terms:
        i = made.randrange(len(t))
        words |= {t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + t[i + 1:i + 2] + t[i:i + 1] + t[i + 2:], "y" + t + "z", t[1:-1], t[:i] + "xx" + t[i + 2:]}
    words = sorted(w for w in words if w)
    found = close_terms(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.word, r.term, r.distance) for r in found.collect()} == brute(words, terms)
    found.explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Python" not in plan and "Arrow" not in plan


def test_edit_limit(spark):
    rows = spark.createDataFrame([("abc", 0), ("abcd", 1), ("abcde", 1), ("abcdef", 2), ("12345", 0)], "w string, n int")
    assert all(r.n == r.m for r in rows.withColumn("m", edit_limit(F.col("w"))).collect())


def test_variants_cover_lookalikes_and_split_glyphs(spark):
    words = spark.createDataFrame([("cуxое",), ("брют",), ("6рют",), ("красн0е",)], "word string")
    found = {(r.raw, r.word) for r in variants_of(words).collect()}
    assert ("брют", "bryut") in found
    assert ("6рют", "bryut") in found
    assert ("красн0е", "krasnoe") in found


def test_joined_words_match_their_parts(spark):
    words = spark.createDataFrame([("almavalley",)], "word string")
    terms = spark.createDataFrame([("alma",), ("valley",)], "term string")
    joined = spark.createDataFrame([("almavalley", ["alma", "valley"])], "joined string, parts array<string>")
    rows = term_matches(words, terms, joined).collect()
    assert {(r.term, r.method, round(r.match_strength, 2)) for r in rows} == {
        ("alma", "joined", 0.96), ("valley", "joined", 0.96)}
