"""Views of equal vectors are compared once, and their cards and queries are told apart afterwards."""
import numpy as np
from pyspark.sql import functions as F

from catmatch.operators import vector_blocks as vb

from tests.test_vector_blocks import brute


def test_copies_on_both_sides(spark):
    made = np.random.default_rng(6)
    vectors = [v.tolist() for v in made.normal(size=(9, 5))]
    pick = lambda: vectors[made.integers(9)]
    kind = lambda names: made.choice(names).item()
    queries = [(q, q * 10 + k, kind(["body", "label", "reference"]), pick()) for q in range(60) for k in range(3)]
    gallery = [(c * 10 + k, c, kind(["body", "label", "reference"]), [f"c{c % 70}"], pick()) for c in range(120) for k in range(2)]
    q = spark.createDataFrame(queries, "query_id long, view_id long, family string, vector array<double>")
    g = spark.createDataFrame(gallery, "view_id long, record_id long, family string, slugs array<string>, vector array<double>")
    blocks = vb.build_blocks(g, block_views=4)
    assert blocks.views.count() <= 18  # nine vectors, two kinds
    for limit in (1, 4, 30):
        found = vb.branch_rankings(q, None, limit, blocks=blocks, block_views=4, query_views=5)
        rows = {tuple(r) for r in found.select("query_id", "branch", "slug", "query_view", "gallery_view", "rank").collect()}
        assert rows == brute(queries, gallery, limit)


def test_groups_hold_all_pivots_and_no_more_than_they_may():
    made = np.random.default_rng(2)
    pivots, counts = made.normal(size=(40, 6)), made.integers(0, 30, 40)
    groups = vb._grouped(pivots, counts, 50)
    for g in set(groups.tolist()):
        assert counts[groups == g].sum() <= 50 or (counts[groups == g] > 0).sum() == 1
    assert vb._grouped(np.zeros((0, 0)), np.zeros(0, np.int64), 5).tolist() == []


def test_a_cell_lets_nothing_below_the_bar_leave():
    import pyarrow as pa
    left = pa.table({"needle": pa.array([1, 2], pa.int64()), "bar": pa.array([0.5, None], pa.float64()), "vector": [[1.0, 0.0], [0.0, 1.0]]})
    cards = [[{"slug": "a", "view_id": 1}], [{"slug": "b", "view_id": 2}, {"slug": "c", "view_id": 3}]]
    right = pa.table({"cards": cards, "vector": [[0.8, 0.6], [0.0, 1.0]]})
    found = vb._cell(2)(left, right).to_pylist()
    assert [(r["needle"], r["slug"], r["cosine"]) for r in found] == [(1, "a", 0.8), (2, "b", 1.0), (2, "c", 1.0)]
