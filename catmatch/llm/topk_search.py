"""Exact top-k search by inner product: norm buckets with local cosine thresholds.

Vectors are grouped by length (norm) into buckets, and buckets are cut into blocks. A first
pass gives every query the k-th best score within a block of the longest vectors. In the second
pass a query and a bucket have a local cosine threshold: the score to beat over the product of
the query's length and the bucket's longest. A bucket whose threshold is over one is passed by.
Else the bucket is pruned by coordinates or by length: the angle that the threshold allows
bounds the coordinates in which the query's direction is largest, and the length that the score
needs bounds the vectors' lengths. Each block chooses the threshold from which coordinates leave
fewer vectors than lengths over all its queries; what stays is multiplied out in whole numbers.

Defined cases: vectors that are null or hold null or non-finite components take no part; scores
are of vectors of equal dimension; a null vec_id is never a query, and is last among ties; rows
that repeat a vec_id are candidates each, but not for a query of the same id; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catmatch.llm.common import materialize

#: Buckets per doubling of the length, and rows of a block of candidates or queries.
BUCKETS_PER_DOUBLING = 8
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 512
#: Coordinates of a query's direction that bound a vector's.
FOCUS = 3
_LAST_ID = 2**63 - 1
SLACK = 1e-6  # lengths are rounded: a bound may only be too weak
EXACT_BELOW = 2.0 ** 52  # sums of products under it are exact as doubles


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id, v: array of floor(scale * x) as long, dim, length2; without unusable vectors."""
    v = F.col(vector_column)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    kept = vectors.filter(usable).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))
    return kept.select("id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("length2"))


_BLOCK = pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()),
                    ("bars", pa.binary()), ("length", pa.float64()), ("low_bar", pa.float64())])


def blocks(vectors: DataFrame, size: int, bucketed: bool) -> DataFrame:
    """id, v, dim, length2, bar → rows of at most about `size` vectors of like length, packed as 64-bit numbers.

    A bucket, however full, is dealt out over as many blocks as its count asks for.
    """
    by_length = F.when(F.col("length2") > 0, F.floor(F.log2("length2") / 2 * BUCKETS_PER_DOUBLING)).otherwise(-10**6)
    rows = vectors.withColumn("bucket", by_length.cast("long") if bucketed else F.lit(0).cast("long"))
    counts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(counts, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))

    def pack(key, table):
        ids = table.column("id").fill_null(_LAST_ID).to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        data = table.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), key[0].as_py())[order]
        bars = table.column("bar").to_numpy().astype(np.float64)[order]
        length = float(np.sqrt((data.astype(float) ** 2).sum(1).max()))
        return pa.table({"dim": [key[0].as_py()], "bucket": [key[1].as_py()], "block": [key[2].as_py()], "ids": [ids[order].tobytes()],
                         "data": [data.tobytes()], "bars": [bars.tobytes()], "length": [length], "low_bar": [float(bars.min())]}, schema=_BLOCK)

    schema = "dim int, bucket long, block int, ids binary, data binary, bars binary, length double, low_bar double"
    return materialize(dealt.select("dim", "bucket", "block", "id", "v", "bar").groupBy("dim", "bucket", "block").applyInArrow(pack, schema))


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def coordinates_from(thresholds: np.ndarray, by_length: np.ndarray, by_coordinates: np.ndarray) -> float:
    """The local threshold from which pruning by coordinates pays: what is left of all queries is least; infinite if nowhere.

    by_length, by_coordinates: the vectors that each pruning leaves a query of that threshold.
    """
    order = np.argsort(-thresholds, kind="stable")
    saved = np.cumsum((by_length - by_coordinates)[order])
    last = np.append(np.diff(thresholds[order]) != 0, True)  # queries of one threshold go the same way
    saved = np.where(last, saved, 0) if len(saved) else saved
    return float(thresholds[order[saved.argmax()]]) if saved.max(initial=0) > 0 else np.inf


def _best(queries: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], bars: np.ndarray, k: int):
    """(query id, vector id, score) of what may be among a query's k best within the block, at least equal to its bar."""
    (q_ids, q), (v_ids, v) = queries, vectors
    v_length = np.sqrt((v.astype(float) ** 2).sum(1))
    ascending = np.argsort(v_length, kind="stable")
    v_ids, v, v_length = v_ids[ascending], v[ascending], v_length[ascending]
    q_length, longest = np.sqrt((q.astype(float) ** 2).sum(1)), v_length.max(initial=0.0)
    reach = q_length * longest * (1 + SLACK)
    needed = bars - SLACK
    # Minus one: nothing is known of the angle.
    threshold = np.where(np.isfinite(bars) & (reach > 0), needed / np.where(reach > 0, reach, 1.0), np.where(needed > 0, np.inf, -1.0))
    open_ = np.flatnonzero(threshold <= 1)
    threshold = np.maximum(threshold, -1.0)
    shortest = np.where(q_length > 0, needed / np.where(q_length > 0, q_length * (1 + SLACK), 1.0), -np.inf)
    start = np.searchsorted(v_length, shortest, "left")

    floats, floats_q = v.astype(float), q.astype(float)
    direction = floats / np.where(v_length > 0, v_length, 1.0)[:, None]
    q_direction = floats_q / np.where(q_length > 0, q_length, 1.0)[:, None]
    focus = np.argsort(-np.abs(q_direction), axis=1, kind="stable")[:, :FOCUS]
    angle, allowed = _angles(np.take_along_axis(q_direction, focus, 1)), _angles(threshold)[:, None]
    low = np.cos(np.minimum(angle + allowed, np.pi)) - SLACK
    high = np.cos(np.maximum(angle - allowed, 0.0)) + SLACK
    # A vector of length zero has no direction, and scores zero: only a bar above that excludes it.
    can_turn = (threshold > 0) & (focus.shape[1] > 0)
    lists = {f: np.argsort(direction[:, f], kind="stable") for f in set(focus[open_[can_turn[open_]], 0].tolist())} if focus.shape[1] else {}
    first, last = np.zeros(len(q), int), np.full(len(q), len(v))
    for f, order in lists.items():
        asked = np.flatnonzero(can_turn & (focus[:, 0] == f))
        column = direction[order, f]
        first[asked] = np.searchsorted(column, low[asked, 0], "left")
        last[asked] = np.searchsorted(column, high[asked, 0], "right")
    turning = open_[can_turn[open_]]
    switch = coordinates_from(threshold[turning], len(v) - start[turning], last[turning] - first[turning])

    exact = q_length.max(initial=0.0) * longest < EXACT_BELOW
    out = []
    for i in open_:
        bar = bars[i]
        if can_turn[i] and threshold[i] >= switch:
            near = lists[focus[i, 0]][first[i]:last[i]]
            for n in range(1, focus.shape[1]):
                x = direction[near, focus[i, n]]
                near = near[(x >= low[i, n]) & (x <= high[i, n])]
        else:
            near = np.arange(start[i], len(v))
        near = near[v_ids[near] != q_ids[i]]
        scores = (floats[near] @ floats_q[i]).astype(np.int64) if exact else v[near] @ q[i]
        if np.isfinite(bar):
            near, scores = near[scores >= bar], scores[scores >= bar]
        if len(near) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            near, scores = near[scores >= cut], scores[scores >= cut]
        best = np.lexsort((v_ids[near], -scores))[:k]
        out.extend((int(q_ids[i]), int(v_ids[near[j]]), int(scores[j])) for j in best)
    return out


def _unpack(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.int64).reshape(len(ids), dim)


def _search(query_blocks: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The stated queries against the candidates, block by block → query_id, vec_id, score.

    A pair of blocks of which no query can reach its bar is never made.
    """
    asked = query_blocks.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "data", "bars", "length", "low_bar")])
    reach = F.col("q_low_bar") <= F.col("q_length") * F.col("length") * (1 + SLACK) + SLACK
    cells = asked.join(candidates, "dim").filter(reach)

    def run(table):
        found = []
        for r in table.to_pylist():
            found += _best(_unpack(r["q_ids"], r["q_data"], r["dim"]), _unpack(r["ids"], r["data"], r["dim"]),
                           np.frombuffer(r["q_bars"], np.float64), k)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns)})

    # One cell at a time is in memory.
    return cells.groupBy("dim", "bucket", "block", "q_block").applyInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for each query, its own row left out, ties to the smaller id."""
    lowest = F.lit(float("-inf"))
    usable = whole_vectors(vectors, id_column, vector_column, scale).withColumn("bar", lowest)
    asked = whole_vectors(queries.filter(F.col(id_column).isNotNull()), id_column, vector_column, scale)
    candidates = blocks(usable, CANDIDATE_BLOCK, bucketed=True)
    # First pass: against one block of the longest vectors of each dimension, for the k-th best score there.
    longest = candidates.groupBy("dim").agg(F.max_by(F.struct("bucket", "block"), F.struct("length", "bucket", "block")).alias("at"))
    first = candidates.join(longest.select("dim", "at.bucket", "at.block"), ["dim", "bucket", "block"], "left_semi")
    start = _search(blocks(asked.withColumn("bar", lowest), QUERY_BLOCK, bucketed=False), first, k)
    bars = (_ranked(start, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar"))
            .filter(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("bar").cast("double").alias("bar")))
    barred = asked.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", lowest))
    found = _search(blocks(barred, QUERY_BLOCK, bucketed=False), candidates, k)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"),
                                    F.when(F.col("vec_id") != _LAST_ID, F.col("vec_id")).alias("vec_id"), "score")
