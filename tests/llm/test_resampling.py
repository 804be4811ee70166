"""Importance resampling against brute force: features, gains, weights, scores and ranks."""
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from catmatch.llm import resampling
from catmatch.llm.common import table
from catmatch.llm.queries import QUERIES
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def buckets_of(text):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    corpus, wanted = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    for counts, texts in ((corpus, [t for _, t in rows]), (wanted, target)):
        for text in texts:
            np.add.at(counts, np.array(buckets_of(text), np.int64), 1)
    own, sought = int(corpus.sum()), int(wanted.sum())
    gain = [math.floor(1000 * math.log((float(t) + 1) * (own + 10000) / ((float(s) + 1) * (sought + 10000)))) for s, t in zip(corpus, wanted)]
    out = []
    for doc_id, text in rows:
        found = buckets_of(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, row in enumerate(fit[:5 * len(fit) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, SMALL, "benchmark").select("text").collect()]
    df = QUERIES["op13_importance_resampling"](spark, SMALL)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    found = sorted(map(tuple, df.collect()), key=str)
    assert found == brute(rows, target)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 5 * sum(r[5] >= 20 for r in found) // 100 + 1))


def test_edge_rows(spark, documents, edge_rows):
    lines = "Home | About\n\nHome | About\n a\nb c\n\x0bd\x00e f g h i j\r\nÀÉ 1٣ x\n" * 3
    rows = [*edge_rows, (None, lines), (None, lines), (13, lines), (13, lines), (13, lines + "more"), (14, "z" * 100_000), (15, "q\n" * 5000)]
    rows += [(k, lines + f"only {k}") for k in range(20, 80)]
    target = documents([(0, "Home about prose w5x5"), (1, None), (1, "a b c d e")])
    docs = documents(rows)
    by_rank = lambda found: sorted(map(tuple, found), key=str)
    found = resampling.importance_draw(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
    expected = brute(rows, ["Home about prose w5x5", None, "a b c d e"])
    assert by_rank(found) == expected
    kept = resampling.resample(docs, target)
    assert kept.columns == docs.columns
    texts = dict(rows[17:])
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((r[0], texts.get(r[0], dict(rows).get(r[0]))) for r in expected if r[4])
    for empty in (documents([]), documents([(1, None), (2, "")])):
        n = empty.count()
        assert [tuple(r)[1:] for r in resampling.importance_draw(empty, target).select("doc_id", "n_features", "rank").collect()] == [(0, None)] * n
        assert resampling.resample(empty, target).count() == 0
    assert by_rank(resampling.importance_draw(docs, documents([])).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()) == brute(rows, [])


def test_ties_are_ranked_by_id(spark):
    rows = spark.createDataFrame([(k, 30, 87, 5, (k * 7) % 3) for k in range(1000)], "doc_id long, n_words long, n_features long, weight long, score long")
    rows = rows.selectExpr("struct(doc_id) as row", "n_words", "n_features", "weight", "score").repartition(7)
    found = [(r["row"]["doc_id"], r["rank"]) for r in resampling.drawn(rows, percent=50).filter("rank is not null").collect()]
    expected = sorted(range(1000), key=lambda k: (-((k * 7) % 3), k))[:500]
    assert sorted(found, key=lambda f: f[1]) == [(k, i + 1) for i, k in enumerate(expected)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1É\n |", max_size=80), st.integers(1, 4))
def test_lines_and_crossings_make_all_runs(text, size):
    words, lines = resampling.Words(), resampling._lines(text.encode())
    inside = [b for _, found in resampling.line_buckets(lines, words, size, 10_000) for b in found.tolist()]
    across = resampling.crossing_buckets([lines], words, size, 10_000)[1].tolist()
    spelled = words_of(text)
    assert sorted(inside + across) == sorted(zlib.crc32(" ".join(spelled[i:i + n]).encode()) % 10_000
                                             for n in range(1, size + 1) for i in range(len(spelled) - n + 1))


@pytest.mark.parametrize("length", [0, 1, 7, 255, 256, 70_000])
def test_appended_crc(length):
    left, right = b"some words", bytes(range(256)) * (length // 256 + 1)
    found = resampling.appended(np.array([zlib.crc32(left)], np.uint32), np.array([zlib.crc32(right[:length])], np.uint32), np.array([length]))
    assert found.tolist() == [zlib.crc32(left + right[:length])]
