"""Exact top-k search, the pipeline and the registration of all queries."""
import math
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

import brute
import corpus_pipeline
from catmatch.llm import quality_rules, topk_search
from catmatch.llm.common import table
from catmatch.llm.queries import QUERIES
from conftest import SMALL


def brute_top_k(rows, k=5):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), (i is None, i or 0)) for i, b in whole if i != q and len(a) == len(b))
            out |= {(q, n + 1, None if i[0] else i[1], -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32) * (1 + i % 5)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(20)] + [(500, None), (550, [1.0, float("nan")] * 3), (600, [1.0, None] * 3),
             (650, [float("inf")] * 6), (700, [0.0] * 6), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (None, rows[0][1]), (800, [])]
    vectors = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    found = topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    assert {tuple(r) for r in found} == brute_top_k(rows) and len(found) == len(set(found))
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_prunings_are_chosen_by_the_threshold():
    at = topk_search.coordinates_from
    counts = lambda *n: np.array(n)
    assert at(np.array([0.9, 0.2, 0.5]), counts(9, 9, 9), counts(1, 20, 8)) == 0.5
    assert at(np.array([0.9, 0.9, 0.5]), counts(9, 9, 9), counts(1, 30, 9)) == np.inf  # one threshold, one way
    assert at(np.array([0.9, 0.5]), counts(2, 2), counts(5, 5)) == np.inf and at(np.array([]), counts(), counts()) == np.inf


@pytest.mark.parametrize("lengths, noise", [((1, 1), 0.05), ((1, 1), 3.0), ((0.01, 100), 0.05), ((0.01, 100), 3.0), ((0, 0), 1.0)])
def test_prunings_lose_nothing(monkeypatch, lengths, noise):
    """Directions that crowd or scatter, lengths alike or spread: every score that reaches the bar is found, either way."""
    rng = np.random.default_rng(8)
    v = np.round(1000 * rng.uniform(*lengths, size=(500, 1)) * (rng.normal(size=8) + noise * rng.normal(size=(500, 8)))).astype(np.int64)
    q = np.vstack([v[:40], -v[:5], np.zeros((1, 8), np.int64)])
    ids, q_ids = np.arange(500), np.arange(1000, 1000 + len(q))
    scores = q @ v.T
    for bars in (np.sort(scores, 1)[:, -6].astype(float), np.full(len(q), -np.inf), np.full(len(q), 0.0), scores.max(1) + 1.0):
        wanted = {(int(q_ids[i]), int(j), int(scores[i, j])) for i in range(len(q)) for j in np.flatnonzero(scores[i] >= bars[i])}
        for choose in (topk_search.coordinates_from, lambda *_: -1.0, lambda *_: np.inf):  # chosen, coordinates only, lengths only
            with monkeypatch.context() as m:
                m.setattr(topk_search, "coordinates_from", choose)
                assert set(topk_search._best((q_ids, q), (ids, v), bars, 500)) == wanted


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "mixing", "best_fit_packing"]
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, results[-1], SMALL).write.parquet(str(tmp_path / name))
        results.append(spark.read.parquet(str(tmp_path / name)))
    start, good, unique, cut, mixed, packed = [r.collect() for r in results]
    assert all(r.dtypes == docs.dtypes for r in results[:-1])
    kept = {r["row"]["doc_id"] for r in quality_rules.judge_quality(docs).filter("kept").collect()}
    assert sorted(good) == sorted(r for r in start if r["doc_id"] in kept)
    component = brute.components([(r["doc_id"], r["text"]) for r in good])
    assert sorted(unique) == sorted(r for r in good if component[r["doc_id"]][1] == r["doc_id"])
    expected = brute.repeats_removed([r["text"] for r in unique])
    words = {r["doc_id"]: len(brute.words(r["text"])) for r in cut}
    assert words == {r["doc_id"]: n - gone for r, (n, gone, _) in zip(unique, expected)}
    assert set(mixed) <= set(cut) and len(mixed) > 0.6 * len(cut)
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)


def test_pipeline_runs_on_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['catmatch.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(x.startswith('op') and x[2].isdigit() for x in q))"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 100
