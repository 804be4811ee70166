"""Exact nearest cards of every query and branch with the views that won, over pruned blocks of the gallery.

The gallery is dealt to pivots, some of its own views; a pivot's views lie within a known angle of it,
its radius, and are cut into parts of bounded size. By the triangle inequality no view of a block is nearer to a query
than the pivot is, less the radius. A query first meets the block that can be nearest, and the next ones
until they hold enough views; the best cards there give its bar. It then meets only the blocks
that can still reach the bar. A cell, the queries of a chunk against a part, is a few matrix products; the best
cards of a cell leave it with the views of their maximum. Every card among the best of its query is
among the best of the cell that holds its winning view, so nothing else is needed.

Equal vectors are compared once: on both sides only distinct ones travel, and neighbouring blocks travel together, as a
vector is sent to every cell it meets. Of cards that share a vector the first by slug are enough. Queries take the
list of their vector at the end.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from catmatch import fixed_values as fv
from catmatch.functions import vectors as vx
from catmatch.functions.scalars import packaging_factor
from catmatch.operators.ranking import top_k
from catmatch.operators.visual import _matrix, query_branches, raw_gallery_branches, raw_query_branches, reciprocal_rank_fusion  # noqa: F401
from catmatch.sources.tables import keep, slots

#: Vectors of a block and of a chunk, and pivots at most: they go to every task.
BLOCK_VIEWS, QUERY_VIEWS, MOST_PIVOTS = 4096, 16384, 1024
#: Blocks that travel together, and entries of a matrix product.
_GROUPED, _ENTRIES = 4, 2_000_000
#: Cosines are compared at so many places; equal vectors tie whatever block they lie in.
PLACES, _SLACK = 9, 2e-9


@dataclass
class GalleryBlocks:
    """Build once for all searches of a gallery."""
    views: DataFrame          # kind, pivot, group, vid, vector: a row per distinct vector
    names: DataFrame          # vid, slug, view_id: the cards that share a vector, each with its first view
    sizes: DataFrame          # kind, group, n
    pivots: np.ndarray        # a unit vector per row
    radius: dict[str, np.ndarray]  # by kind: the largest angle to the pivot, -1 where it has no views
    counts: dict[str, np.ndarray]
    groups: dict[str, np.ndarray]  # by kind: the group of each pivot


def _named(rows: DataFrame) -> DataFrame:
    """Rows with what names their vector: two hashes, so that no two vectors share them."""
    return rows.withColumn("_a", F.xxhash64("vector")).withColumn("_b", F.xxhash64(F.lit("b"), "vector"))


def _distinct_vectors(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, _a, _b, unit vector, number): each vector once, numbered."""
    once = _named(rows.select(key, "vector")).groupBy(key, "_a", "_b").agg(F.first("vector").alias("vector"))
    return keep(once.withColumn("vector", vx.normalize(F.col("vector"))).withColumn(number, F.monotonically_increasing_id()))


def _grouped(pivots: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """A group for every pivot: neighbours along the direction they differ most in, of at most `most` views or one pivot."""
    centred = pivots - pivots.mean(axis=0) if len(pivots) else pivots
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if centred.size else np.zeros(len(pivots))
    group, held, at = np.zeros(len(pivots), np.int64), 0, 0
    for p in np.argsort(along, kind="stable"):
        if held and held + counts[p] > most:
            held, at = 0, at + 1
        group[p], held = at, held + counts[p]
    return group


def build_blocks(gallery: DataFrame, augment: bool = False, block_views: int = BLOCK_VIEWS, most_pivots: int = MOST_PIVOTS) -> GalleryBlocks:
    rows = raw_gallery_branches(gallery, augment, "view_id")
    views = _distinct_vectors(rows, "kind", "vid")
    named = _named(rows).groupBy("kind", "_a", "_b", "slug").agg(F.min("view_id").alias("view_id"))
    names = keep(named.join(views.select("kind", "_a", "_b", "vid"), ["kind", "_a", "_b"]).select("vid", "slug", "view_id"))
    n = min(most_pivots, -(-2 * views.count() // block_views))
    drawn = views.select("vector", "_a", "_b").dropDuplicates(["_a", "_b"]).orderBy("_a", "_b").limit(max(n, 1))
    pivots = _matrix(drawn.select("vector").toArrow().column(0))  # at most most_pivots rows
    sent = views.sparkSession.sparkContext.broadcast(pivots)
    views = views.select("kind", "vid", "vector")
    schema = T.StructType([*views.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                near = _matrix(pa.chunked_array([batch.column("vector")])) @ sent.value.T
                best = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angle)], names=schema.names)

    dealt = keep(views.mapInArrow(deal, schema))
    spans = dealt.groupBy("kind", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()  # a row per kind and pivot
    radius = {k: np.full(len(pivots), -1.0) for k in ("body", "detail")}
    counts = {k: np.zeros(len(pivots), np.int64) for k in radius}
    for r in spans:
        radius[r["kind"]][r["pivot"]], counts[r["kind"]][r["pivot"]] = r["radius"], r["n"]
    groups = {k: _grouped(pivots, counts[k], _GROUPED * block_views) for k in radius}
    table = [(k, p, int(g)) for k in radius for p, g in enumerate(groups[k])]  # a row per kind and pivot
    placed = dealt.drop("angle").join(F.broadcast(views.sparkSession.createDataFrame(table, "kind string, pivot int, group int")), ["kind", "pivot"])
    return GalleryBlocks(placed, names, placed.groupBy("kind", "group").agg(F.count(F.lit(1)).alias("n")), pivots, radius, counts, groups)


def _asked(rows: DataFrame, blocks: GalleryBlocks, limit: int, first: bool, grouped: bool = False) -> DataFrame:
    """Query views (with a bar, null where all counts) with the pivots they meet: the first ones, or those left that can reach the bar.

    `grouped` tells the groups of those pivots instead, and leaves out groups that were met at first.
    """
    column = "group" if grouped else "pivot"
    sent = rows.sparkSession.sparkContext.broadcast((blocks.pivots, blocks.radius, blocks.counts, blocks.groups))
    schema = T.StructType([*rows.schema.fields, T.StructField("kind", T.StringType()), T.StructField(column, T.IntegerType())])

    def meet(batches):
        pivots, radius, counts, groups = sent.value
        for batch in batches:
            branch = np.array(batch.column("branch").to_pylist(), object)
            for kind in radius:
                some = np.flatnonzero((branch == "body") == (kind == "body"))
                there = np.flatnonzero(counts[kind])
                if not len(some) or not len(there):
                    continue
                there = there[np.argsort(groups[kind][there], kind="stable")]
                part = batch.take(pa.array(some))
                angle = np.arccos(np.clip(_matrix(pa.chunked_array([part.column("vector")])) @ pivots[there].T, -1, 1))
                bound = np.cos(np.maximum(angle - radius[kind][there] - 1e-7, 0))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(counts[kind][there][order], axis=1) - counts[kind][there][order]
                opening = np.zeros(bound.shape, bool)
                np.put_along_axis(opening, order, held < 4 * limit, axis=1)
                bar = np.array([-2.0 if b is None else b for b in part.column("bar").to_pylist()])
                reach = bound >= bar[:, None] - _SLACK
                names = there
                if grouped:
                    names, starts = np.unique(groups[kind][there], return_index=True)
                    opening, reach = (np.logical_or.reduceat(m, starts, axis=1) for m in (opening, reach))
                rows_, columns = np.nonzero(opening if first else ~opening & reach)
                for at in range(0, len(rows_), 10_000):
                    picked = part.take(pa.array(rows_[at:at + 10_000]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array([kind] * picked.num_rows),
                                                      pa.array(names[columns[at:at + 10_000]].astype(np.int32))], names=schema.names)

    return rows.mapInArrow(meet, schema)


FOUND = T.StructType([T.StructField("needle", T.LongType()), T.StructField("slug", T.StringType()), T.StructField("cosine", T.DoubleType()),
                      T.StructField("gallery_view", T.LongType())])


def _cell(limit: int):
    """Task function of one cell: the best cards of every vector asked for, none below its bar, with the view of their maximum."""
    def best_of_cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            asked, vectors = _matrix(left["vector"]), _matrix(right["vector"])
            needles = left["needle"].to_numpy()
            bars = left["bar"].combine_chunks().fill_null(-2.0).to_numpy(zero_copy_only=False) - _SLACK
            lists = right["cards"].combine_chunks()
            ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
            cards = lists.flatten()
            slugs, card = np.unique(np.array(cards.field("slug").to_pylist(), object), return_inverse=True)
            view = cards.field("view_id").to_numpy(zero_copy_only=False)
            # A card lies in so many vectors at most, so this many of the nearest hold `limit` cards.
            enough = limit * int(np.bincount(card).max())
            step = max(1, _ENTRIES // len(vectors))
            for at in range(0, len(asked), step):
                near = np.round(asked[at:at + step] @ vectors.T, PLACES)
                bar = bars[at:at + step, None]
                if near.shape[1] > enough:
                    bar = np.maximum(bar, -np.partition(-near, enough - 1, axis=1)[:, enough - 1:enough])
                rows, columns = np.nonzero(near >= bar)
                # Rows whose lists are worked on at once.
                size = np.cumsum(np.r_[0, (ends[columns + 1] - ends[columns])])
                while len(rows):
                    upto = max(int(np.searchsorted(size, size[0] + _ENTRIES)), 1)
                    upto = len(rows) if upto >= len(rows) else int(np.searchsorted(rows, rows[upto])) or int(np.searchsorted(rows, rows[0], "right"))
                    r, c = rows[:upto], columns[:upto]
                    rows, columns, size = rows[upto:], columns[upto:], size[upto:]
                    n = ends[c + 1] - ends[c]
                    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[c], n)
                    r, cosine, who, seen = np.repeat(r, n), np.repeat(near[r, c], n), card[entry], view[entry]
                    order = np.lexsort((seen, who, -cosine, r))  # the first of a card is its maximum by its first view
                    r, cosine, who, seen = r[order], cosine[order], who[order], seen[order]
                    _, once = np.unique(r.astype(np.int64) * len(slugs) + who, return_index=True)
                    once.sort()
                    r, cosine, who, seen = r[once], cosine[once], who[once], seen[once]
                    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    kept = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)])) < limit
                    out.append((needles[at + r[kept]], slugs[who[kept]], cosine[kept], seen[kept]))
        each = [np.concatenate(o) for o in zip(*out)] if out else [[], [], [], []]
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64())
        return pa.table([pa.array(o, k) for o, k in zip(each, kinds)], names=FOUND.names)
    return best_of_cell


def _compared(needles: DataFrame, blocks: GalleryBlocks, lists: DataFrame, limit: int, first: bool, block_views: int, query_views: int) -> DataFrame:
    """(needle, slug, cosine, gallery_view): the best cards of all cells that vectors meet, merged."""
    # What they meet is told twice, to be counted and to be sent: to keep it would write every vector for every group.
    asked = _asked(needles, blocks, limit, first, grouped=True)
    wide = slots(needles)
    cells = keep(blocks.sizes.select("kind", "group", F.ceil(F.col("n") / (_GROUPED * block_views)).cast("int").alias("parts")))
    width = F.lit(-(-wide // (cells.agg(F.sum("parts")).collect()[0][0] or 1)))
    few = F.least(F.ceil(F.col("_n") / 512), width)  # few groups are spread over the cluster by their chunks
    chunks = asked.groupBy("kind", "group").agg(F.count(F.lit(1)).alias("_n")).select(
        "kind", "group", F.greatest(F.ceil(F.col("_n") / query_views), few).cast("int").alias("chunks"))
    cut = F.broadcast(keep(cells.join(chunks, ["kind", "group"])))  # a row per kind and group
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(cut, ["kind", "group"]).select(
        "needle", "bar", "vector", "kind", "group", F.pmod(F.xxhash64("needle"), "chunks").cast("int").alias("chunk"), each("parts").alias("part"))
    right = blocks.views.join(lists, "vid").join(cut, ["kind", "group"]).select(
        "cards", "vector", "kind", "group", F.pmod(F.xxhash64("vid"), "parts").cast("int").alias("part"), each("chunks").alias("chunk"))
    key = ["kind", "group", "part", "chunk"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_cell(limit), FOUND)


def _merge_needles(found: DataFrame, limit: int) -> DataFrame:
    best = found.repartition("needle").groupBy("needle", "slug").agg(
        F.max("cosine").alias("cosine"), F.max_by("gallery_view", F.struct("cosine", -F.col("gallery_view"))).alias("gallery_view"))
    return top_k(best, ["needle"], [F.col("cosine").desc(), F.col("slug")], limit)


def merge_rankings(found: DataFrame, limit: int) -> DataFrame:
    """The best `limit` cards of every query and branch out of partial lists that each hold their own best."""
    place = F.struct("cosine", -F.col("gallery_view"), -F.col("query_view"))
    best = found.repartition("query_id", "branch").groupBy("query_id", "branch", "slug").agg(
        F.max("cosine").alias("cosine"), F.max_by("query_view", place).alias("query_view"), F.max_by("gallery_view", place).alias("gallery_view"))
    return top_k(best, ["query_id", "branch"], [F.col("cosine").desc(), F.col("slug")], limit)


def branch_rankings(queries: DataFrame, gallery: DataFrame | None, limit: int = 10, augment: bool = False, blocks: GalleryBlocks | None = None,
                    block_views: int = BLOCK_VIEWS, query_views: int = QUERY_VIEWS) -> DataFrame:
    """(query_id, branch, slug, cosine, query_view, gallery_view, rank): the best `limit` cards of every branch of every query."""
    blocks = blocks or build_blocks(gallery, augment, block_views)
    rows = raw_query_branches(queries, "view_id").withColumn("_body", F.col("branch") == "body")
    distinct = _distinct_vectors(rows, "_body", "needle")
    names = ["_body", "_a", "_b"]
    asks = keep(_named(rows).select("query_id", "branch", "view_id", *names).join(distinct.select("needle", *names), names).select(
        "query_id", "branch", F.col("view_id").alias("query_view"), "needle",
        F.count(F.lit(1)).over(W.partitionBy("query_id", "branch")).alias("_views")))
    needles = distinct.select("needle", F.when(F.col("_body"), "body").otherwise("label").alias("branch"), "vector")
    # Of the cards of one vector the first by slug are as good as any: no more than `limit` can be among the best.
    lists = keep(top_k(blocks.names, ["vid"], [F.col("slug")], limit, "_n").groupBy("vid").agg(
        F.collect_list(F.struct("slug", "view_id")).alias("cards")))
    open_bar = needles.withColumn("bar", F.lit(None).cast("double"))
    opened = keep(_merge_needles(_compared(open_bar, blocks, lists, limit, True, block_views, query_views), limit).drop("rank"))
    bars = opened.groupBy("needle").agg(F.count(F.lit(1)).alias("_n"), F.min("cosine").alias("bar")).filter(F.col("_n") == limit).drop("_n")
    left = keep(needles.join(bars, "needle", "left"))
    more = _compared(left, blocks, lists, limit, False, block_views, query_views)
    best = keep(_merge_needles(opened.unionByName(more), limit))
    columns = ["query_id", "branch", "slug", "cosine", "query_view", "gallery_view"]
    found = asks.join(best, "needle")
    alone = found.filter("_views = 1").select(*columns, "rank")
    return alone.unionByName(merge_rankings(found.filter("_views > 1").select(*columns), limit).select(*columns, "rank"))


def visual_candidates(rankings: DataFrame, cards: DataFrame, asked: DataFrame, limit: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Best cards by rank fusion of branch rankings, adjusted by packaging.

    `cards` has (slug, packaging), `asked` a packaging hint per query: (query_id, packaging, reliable). Relation says how they agree.
    """
    fused = reciprocal_rank_fusion(rankings.select("query_id", "branch", "slug", "cosine"))
    hints = cards.select("slug", F.col("packaging").alias("_card"))
    rows = fused.join(hints, "slug").join(asked.select("query_id", F.col("packaging").alias("_asked"), "reliable"), "query_id", "left")
    factor: Column = packaging_factor(F.col("_asked"), F.col("reliable"), F.col("_card"), kinds)
    relation = F.when(F.col("factor") == fv.PACKAGING_MATCH, "match").when(F.col("factor") == fv.PACKAGING_CONFLICT, "conflict").otherwise("unknown")
    scored = rows.withColumn("factor", factor).withColumn("relation", relation).withColumnRenamed("score", "visual_score").withColumn(
        "score", F.col("visual_score") * F.col("factor")).drop("_card", "_asked", "reliable")
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("slug")], limit)
