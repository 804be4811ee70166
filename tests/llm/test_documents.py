"""Quality rules, packing, substring deduplication, mixing, the classifier and the n-gram join."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from catmatch.llm import boosting, mixing, ngram_join, packing, quality_classifier, quality_rules, recompression, substring, tokens
from catmatch.llm.common import table
from catmatch.llm.components import connected_components
from conftest import SMALL


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, SMALL, "documents")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def python_em(votes, rounds=quality_rules.EM_ROUNDS):
    """The same model over single documents, in plain Python."""
    q = quality_rules
    m = len(q.RULES)
    good_start, bad_start, weight = q.GOOD_VOTES_START, q.BAD_VOTES_START, q.PRIOR_WEIGHT
    share, good, bad = q.SHARE_START, [good_start] * m, [bad_start] * m
    posterior = []
    for step in range(rounds + 1):
        posterior = []
        for v in votes:
            odds = math.log(share / (1 - share))
            for k in range(m):
                odds += max(0.0, math.log(good[k][0] / good[k][1])) if v[k] == 1 else min(0.0, math.log(bad[k][0] / bad[k][1])) if v[k] == -1 else 0
            posterior.append(1 / (1 + math.exp(-odds)))
        if step == rounds:
            break
        mass = sum(posterior), len(votes) - sum(posterior)
        rate = lambda k, said, start: tuple((sum(p if c == 0 else 1 - p for v, p in zip(votes, posterior) if v[k] == said) + weight * start[c])
                                            / (mass[c] + weight) for c in (0, 1))
        good, bad = [rate(k, 1, good_start) for k in range(m)], [rate(k, -1, bad_start) for k in range(m)]
        old, share = share, min(max(mass[0] / sum(mass), q.SHARE_RANGE[0]), q.SHARE_RANGE[1])
        if abs(share - old) < 1e-6:
            rounds = step + 1
    return posterior


def test_quality_rules(documents, edge_rows, small):
    rows = edge_rows + [(1000 + i, t) for i, t in texts_of(small)] + [(None, "x"), (4, "again " * 60)]
    found = quality_rules.judge_quality(documents(rows)).collect()
    assert Counter((r["row"]["doc_id"], *[r["stats"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in found) \
        == Counter((i, *brute.quality_counts(t)) for i, t in rows)
    for r, p in zip(found, python_em([list(r["votes"]) for r in found])):
        failed = r["stats"]["n_words"] < 50 or 100 * r["stats"]["n_repeat_words"] > 50 * r["stats"]["n_words"]
        assert math.isclose(r["good"], p, rel_tol=1e-6, abs_tol=1e-9)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and p >= 0.5)
    assert quality_rules.judge_quality(documents([])).collect() == []


def test_quality_rules_agree_with_labels(spark, small):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    judged = {r["row"]["doc_id"]: r for r in quality_rules.judge_quality(small).collect()}
    assert all(judged[i]["kept"] == bool(label) for i, label in labels.items() if not judged[i]["base_failed"])


def test_keep_good_returns_whole_rows(documents, edge_rows):
    docs = documents(edge_rows)
    kept = quality_rules.keep_good(docs)
    assert kept.dtypes == docs.dtypes
    judged = {r["row"]["doc_id"] for r in quality_rules.judge_quality(docs).filter("kept").collect()}
    assert Counter(kept.collect()) == Counter(r for r in docs.collect() if r["doc_id"] in judged)


def check_packing(pieces, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    expected = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), capacity):
            part = np.array(ids[at:at + capacity], "<u4")
            expected[i, at // capacity, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in pieces) == expected
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(sequences), -(-sum(n for parts in sequences.values() for _, n in parts) // capacity)


def test_packing(documents, edge_rows, small):
    rows = edge_rows + [(1000 + i, t) for i, t in texts_of(small)] + [(None, "x"), (4, "same id"), (20, "<|endoftext|> İstanbul I'm we'RE ǅ Å 1234 a\u0301 <|ENDOFTEXT|>")]
    used, least = check_packing(packing.pack_documents(documents(rows)).collect(), rows, 4096)
    assert used <= least + 1
    assert packing.pack_documents(documents([])).collect() == []


def test_packing_over_several_packers(documents, small):
    rows = texts_of(small)
    pieces = packing.tokenize_pieces(documents(rows), 256).cache()
    out = packing.pack_pieces(pieces, 256, most_open=8, window=64, packer_sequences=64, followed=4).collect()
    used, least = check_packing(out, rows, 256)
    assert used <= 1.03 * least


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert list(fit.add(7, "a")) == [] and list(fit.add(6, "b")) == []
    assert list(fit.add(3, "c")) == [(0, 0, [("a", 0), ("c", 7)])]  # least space is left there
    assert list(fit.add(8, "d")) == [] and [n for n, _, _ in fit.add(9, "e")] == [2]
    assert sorted(n for n, _, _ in fit.rest()) == [1, 3]


def test_substring_dedup(documents, edge_rows, small):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(50)}" for _ in range(60))
    rows = edge_rows + [(1000 + i, t) for i, t in texts_of(small)]
    rows += [(2000 + i, " ".join(f"{i}q{k}" for k in range(rng.randrange(60))) + f" {passage}\n" + f"tail{i} " * (i % 3)) for i in range(40)]
    rows += [(3000 + n, " ".join(f"r{k}" for k in range(n))) for n in (34, 35, 36, 37)] + [(4000, "a b " * 50), (None, "nothing"), (4, "same id")]
    found = substring.removal_digest(documents(rows)).collect()
    assert Counter(map(tuple, found)) == Counter((i, *r) for (i, _), r in zip(rows, brute.repeats_removed([t for _, t in rows])))
    assert substring.removal_digest(documents([])).collect() == []
    docs = documents(rows)
    cut = substring.remove_repeats(docs)
    assert cut.dtypes == docs.dtypes
    assert Counter((r["doc_id"], " ".join(brute.words(r["text"]))) for r in cut.collect()) == Counter(
        (i, " ".join(w)) for (i, _), w in zip(rows, kept_words([t for _, t in rows])))
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None)


def kept_words(texts, window=35):
    split = [brute.words(t) for t in texts]
    counts = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        yield [x for i, x in enumerate(w) if i not in gone]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 20, 10**9):
        words = rng.integers(0, alphabet, 3000).astype(np.uint64)
        words[1000:1200] = words[200:400]
        found = recompression.window_anchors(words, np.array([0, 700, 1500]), 35)
        names = {}
        for begin, end, name in zip(found.window, found.end, found.name):
            for at in range(begin, end):
                assert names.setdefault(words[at:at + 35].tobytes(), name) == name
        assert (found.end - found.window).sum() == 3000 - 3 * 34


def test_mixing_matches_targets(spark, small):
    labels = table(spark, SMALL, "labels")
    found = mixing.mixture(small, labels).toPandas()
    mass = {k: (found.n_tokens * found[f"p_{k}"]).sum() for k in mixing.TARGETS}
    reached = {k: (found.n_tokens * found[f"p_{k}"] * found.rate).sum() for k in mixing.TARGETS}
    for k, weight in mixing.TARGETS.items():
        assert math.isclose(reached[k], min(mass[k], mass["good"] / mixing.TARGETS["good"] * weight), rel_tol=0.02)
    assert (found.rate >= 0).all() and len(found) == small.count()
    assert np.allclose(found[[f"p_{k}" for k in mixing.TARGETS]].sum(axis=1), 1)


def test_mixing_raises_a_domain_to_its_weight(spark):
    """From 90 % good and 10 % poor tokens to halves: rates above one become copies, and the rows returned have the fitted totals."""
    rows = [(i, " ".join(f"{'poor' if i % 10 == 0 else 'good'}{(i + k) % 7}" for k in range(20))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, 4000, 3)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.50, "poor": 0.49, "toxic": 0.01}
    found = mixing.mixture(docs, labels, targets).toPandas()
    good = (found.n_tokens * found.p_good).sum()
    for name in ("good", "poor"):
        mass = found.n_tokens * found[f"p_{name}"]
        assert math.isclose((mass * found.rate).sum(), good * targets[name] / 0.50, rel_tol=0.01)
        assert math.isclose((mass * found.copies).sum(), good * targets[name] / 0.50, rel_tol=0.03)
    mixed = Counter(r["doc_id"] for r in mixing.mix_documents(docs, labels, targets).collect())
    assert mixed == Counter({i: n for i, n in zip(found.doc_id, found.copies) if n})


def plain_rates(tokens, p, weights, most, ridge, rounds=20_000):
    """The same objective by a plain projected gradient with momentum, over single documents."""
    total, mass = tokens.sum(), tokens @ p
    targets = np.minimum(np.array(weights) / weights[0] * mass[0], most * mass)
    steep = np.linalg.eigvalsh((p * tokens[:, None]).T @ p / total)[-1] + ridge
    rate = ahead = np.ones(len(tokens))
    theta = 1.0
    for _ in range(rounds):
        slope = p @ (((tokens * ahead) @ p - targets) / total) + ridge * (ahead - 1)
        new = np.clip(ahead - slope / steep, 0, most)
        if (tokens * (ahead - new)) @ (new - rate) > 0:
            theta = 1.0
        after = (1 + math.sqrt(1 + 4 * theta * theta)) / 2
        ahead, rate, theta = new + (theta - 1) / after * (new - rate), new, after
    return rate, targets


@pytest.mark.parametrize("share", [0.2, 0.01, 0.001, 0.0001])
@pytest.mark.parametrize("clear", [True, False])
def test_rates_of_scarce_domains_against_a_plain_solver(spark, share, clear):
    rng = np.random.default_rng(int(share * 10_000) + clear)
    n, weights = 3000, [0.97, 0.02, 0.01]
    tokens = rng.integers(1, 2000, n).astype(float)
    second = (np.arange(n) < max(1, share * n)) * 0.98 + 0.0001 if clear else rng.beta(0.5, 0.5 * (1 - share) / share, n) * 0.98
    third = rng.random(n) * 0.002
    p = np.stack([1 - second - third, second, third], 1)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "n_tokens long, p array<double>").repartition(4).persist()
    for most in (4.0, 10.0):
        found = mixing.fit_rates(rows, weights, most)
        rates = np.array([r[0] for r in rows.orderBy("n_tokens", "p").select(found.rate).collect()])
        order = sorted(range(n), key=lambda i: (tokens[i], p[i].tolist()))
        expected, targets = plain_rates(tokens, p, weights, most, mixing.RIDGE_TO_ONE)
        assert np.abs(rates - expected[order]).max() < 1e-3 and rates.min() >= 0 and rates.max() <= most
        cost = lambda r: (((tokens * r) @ p - targets) ** 2).sum() / tokens.sum() + mixing.RIDGE_TO_ONE * (tokens * (r - 1) ** 2).sum()  # noqa: B023,E731
        mine = np.empty(n)
        mine[order] = rates
        assert cost(mine) <= min(cost(expected), cost(np.ones(n))) + 1e-6
        assert math.isclose((tokens * mine) @ p[:, 0], tokens @ p[:, 0], rel_tol=0.01)  # the first domain stays whole
    rows.unpersist()


def test_a_labelled_id_of_a_third_of_the_rows_counts_once(spark, small):
    labels = table(spark, SMALL, "labels")
    rows = [tuple(r) for r in small.select("doc_id", "text").join(labels.select("doc_id"), "doc_id").distinct().collect()]
    again = rows + [rows[0]] * len(rows)
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    for fitted in (lambda r: mixing.fit(make(r), labels, 3), lambda r: quality_classifier.fit(make(r), labels)):
        one, two = fitted(rows), fitted(again)
        assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_mixing_edges(spark, documents, edge_rows):
    labels = spark.createDataFrame([(4, 1, 0, 9), (9, 0, 0, 9), (7, None, 1, 9), (None, 1, 1, 9)], "doc_id long, quality int, toxic int, rank int")
    docs = documents(edge_rows + [(None, "x"), (4, "same id")])
    for some in (labels, labels.limit(0)):
        found = mixing.mixture(docs, some)
        assert found.count() == docs.count() and found.filter("rate < 0 or rate is null or copies is null").count() == 0
        mixed = mixing.mix_documents(docs, some)
        assert mixed.dtypes == docs.dtypes and set(mixed.collect()) <= set(docs.collect())
    assert Counter(mixing.mix_documents(docs, labels.limit(0)).collect()) == Counter(docs.collect())  # nothing is known: all stay
    assert mixing.mixture(documents([]), labels).collect() == []
    assert mixing.mix_documents(documents([]), labels).collect() == []


def test_copies_follow_rates(spark):
    from pyspark.sql import functions as F

    made = spark.range(20_000).withColumn("c", mixing.copies_of(F.lit(1.3), F.col("id")))
    assert abs(made.agg(F.avg("c")).first()[0] - 1.3) < 0.02
    assert made.filter("c not in (1, 2)").count() == 0


def test_copies_are_unbiased_near_one(spark):
    from pyspark.sql import functions as F

    for rate in (0.96, 1.04):
        made = spark.range(20_000).withColumn("c", mixing.copies_of(F.lit(rate), F.col("id")))
        assert abs(made.agg(F.avg("c")).first()[0] - rate) < 0.01


def test_classifier(spark, documents, edge_rows):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    found = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    held = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert sum(r["predicted"] == q for r, q in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    edge = documents(edge_rows + [(None, "x"), (4, "same id")])
    for some in (labels.limit(0), odd):
        rows = quality_classifier.classify(edge, some).collect()
        assert len(rows) == len(edge_rows) + 2 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert quality_classifier.classify(documents([]), labels).collect() == []


def test_forest_learns_and_walks():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def walk(row):  # one row, one tree at a time
        binned, total = forest.bins(row[None])[0], forest.start
        for feature, split, value in zip(forest.feature, forest.split, forest.value):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + (binned[feature[node]] > split[node])
            total += value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x[1500:1520]), [walk(r) for r in x[1500:1520]])


def near_copies():
    rng = random.Random(5)
    base = [f"v{rng.randrange(400)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if i % 7 == 3:
            w = w[:rng.randrange(150, 200)]
        rows.append((100 + i, " ".join(w)))
    chain = list(base)
    for i in range(12):
        for _ in range(2):
            chain[rng.randrange(len(chain))] = f"c{rng.randrange(10**6)}"
        rows.append((300 + i, " ".join(chain).upper() if i % 2 else " ".join(chain)))
    return rows


def test_ngram_join(documents, edge_rows, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # so that blocks meet
    rows = [r for r in edge_rows if r[0] != 10] + near_copies() + [(1000 + i, t) for i, t in texts_of(small)]
    expected = brute.components(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(documents(rows)).collect()}
    assert found == expected
    kept = ngram_join.keep_one_of_each(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (n, c) in expected.items() if i == c)


def test_ngram_join_repeated_and_missing_ids(documents):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words stand here"), (None, "a b c d"), (2, "A B C D"), (None, "alone in the world"), (3, None)]
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(documents(rows)).collect())
    assert found == Counter({(1, 2, 1): 3, (None, 2, 1): 1, (2, 2, 1): 1, (None, 2, None): 1, (3, 0, 3): 1})
    assert ngram_join.similar_components(documents([])).collect() == []
    assert ngram_join.keep_one_of_each(documents([])).collect() == []


def test_keep_one_of_each_with_repeated_and_missing_ids(documents):
    """Of every component one row of its smallest id stays; other rows of that id are no copies of it."""
    rows = [(1, "a b c d"), (1, "A b c d"), (1, "other words stand here"), (None, "a b c d"), (2, "A B C D"), (None, "alone in the world"),
            (None, "alone  in the world"), (None, "one more text"), (None, None), (3, None), (3, " "), (3, "third of its kind"), (4, "third of its kind"),
            (4, "fourth of its kind"), (5, "five stands alone")]
    docs = documents(rows)
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    # Rows named by their place, smallest id first, so that brute force sees distinct ids.
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    expected = brute.components([(n, rows[k][1]) for n, k in enumerate(order)])
    plain = lambda i, t: (i, " ".join(brute.words((t or "").lower())))
    assert Counter(plain(r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        plain(*rows[k]) for n, k in enumerate(order) if expected[n][1] == n)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: find(i) for i in list(root)}
