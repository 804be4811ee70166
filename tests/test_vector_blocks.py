"""Pruned vector search against brute force, with winning views."""
import numpy as np
import pytest

from catmatch.operators import vector_blocks as vb


def _views(spark, seed, n_queries, n_cards, spread):
    made = np.random.default_rng(seed)
    centres = made.normal(size=(12, 8))
    vector = lambda: (centres[made.integers(12)] + spread * made.normal(size=8)).tolist()
    queries = [(q, q * 10 + k, made.choice(["body", "label", "flat", "reference"]).item(), vector()) for q in range(n_queries) for k in range(made.integers(1, 4))]
    gallery = [(c * 10 + k, c, made.choice(["body", "label", "flat", "reference", "augmented"]).item(), [f"c{c % 90}", *(["both"] if c % 13 == 0 else [])], vector())
               for c in range(n_cards) for k in range(made.integers(1, 4))]
    gallery += [(100_000 + i, 50_000 + i, "body", [f"copy{i}"], gallery[0][4]) for i in range(15)]
    return (spark.createDataFrame(queries, "query_id long, view_id long, family string, vector array<double>"),
            spark.createDataFrame(gallery, "view_id long, record_id long, family string, slugs array<string>, vector array<double>"), queries, gallery)


def brute(queries, gallery, limit):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    with_body = {q for q, _, f, _ in queries if f == "body"}
    bodies = {r for _, r, f, _, _ in gallery if f == "body"}
    best = {}
    for q, qv, family, a in queries:
        branch = family if family != "reference" else None if q in with_body else "body"
        for gv, record, kind, slugs, b in gallery:
            is_body = kind == "body" or kind == "reference" and record not in bodies
            if branch is None or kind == "augmented" or kind == "reference" and not is_body or (branch == "body") != is_body:
                continue
            place = (round(float(unit(a) @ unit(b)), 9), -gv, -qv)
            for slug in slugs:
                best[q, branch, slug] = max(best.get((q, branch, slug), place), place)
    out = {}
    for (q, branch, slug), (cosine, gv, qv) in best.items():
        out.setdefault((q, branch), []).append((-cosine, slug, -qv, -gv))
    return {(q, b, slug, qv, gv, n + 1) for (q, b), rows in out.items() for n, (_, slug, qv, gv) in enumerate(sorted(rows)[:limit])}


@pytest.mark.parametrize("block_views, query_views, spread, limit", [(16, 7, 0.05, 3), (40, 1000, 1.0, 5), (4096, 1024, 0.3, 10)])
def test_rankings_and_winners_equal_brute_force(spark, block_views, query_views, spread, limit):
    q, g, queries, gallery = _views(spark, limit, 25, 150, spread)
    found = vb.branch_rankings(q, g, limit, block_views=block_views, query_views=query_views)
    assert {tuple(r) for r in found.select("query_id", "branch", "slug", "query_view", "gallery_view", "rank").collect()} == brute(queries, gallery, limit)


def test_cells_are_left_out(spark):
    q, g, _, _ = _views(spark, 1, 40, 400, 0.02)
    blocks = vb.build_blocks(g, block_views=32)
    rows = vb.query_branches(q, "view_id")
    met = [vb._asked(rows.selectExpr("*", f"{bar} as bar"), blocks, 3, first).select("kind", "pivot", "view_id").distinct().count()
           for bar, first in (("cast(null as double)", True), ("cast(0.99 as double)", False))]
    assert sum(met) < 0.5 * rows.count() * len(blocks.pivots)


def test_empty_sides(spark):
    q, g, _, _ = _views(spark, 1, 3, 5, 0.1)
    assert vb.branch_rankings(q.limit(0), g, 3).collect() == []
    assert vb.branch_rankings(q, g.limit(0), 3).collect() == []
