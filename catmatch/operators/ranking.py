"""Ranking, gaps and paging.

Cuts to the best k go through ``row_number() <= k``, which Spark turns into a
per-task limit before the shuffle, so a hot key never reaches one task whole.
Unlimited ranks and running sums are prefix scans: rows are dealt by range of key
and order, worked on per (key, bucket), and carries run over one row per bucket.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from catmatch.sources.tables import keep

#: Rows a bucket holds at most.
MOST_ROWS = 1_000_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """The first k rows of every key in the given total order, with their 1-based rank."""
    window = W.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
            .withColumn(rank, F.col(rank).cast("bigint")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined where all keys are equal, nulls included; right's other columns follow."""
    other = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in keys])
    return left.join(other, same, how).drop(*[f"_same_{c}" for c in keys])


def with_buckets(df: DataFrame, keys: list[str], order: list[Column], rows_per_bucket: int) -> DataFrame:
    """A `_bucket` per row, rising in the given order of every key.

    Rows are dealt by range of (keys, order), with splitters that Spark samples, so a key
    with many rows lies in many buckets however its values are spread; rows equal in all of these are
    told apart by where they come from. Nulls are values like others. Computed once, as a second
    sample would deal them otherwise.
    """
    session = df.sparkSession
    wanted = -(-df.count() // rows_per_bucket)
    most = max(4 * int(session.conf.get("spark.sql.shuffle.partitions")), -(-wanted * rows_per_bucket // MOST_ROWS))
    source = df.withColumn("_from", F.monotonically_increasing_id())
    dealt = source.repartitionByRange(max(1, min(wanted, most)), *[F.col(k).asc_nulls_first() for k in keys], *order, F.col("_from"))
    return keep(dealt.withColumn("_bucket", F.spark_partition_id()).drop("_from"))


def rank_candidates(df: DataFrame, query: str, score: str, key: str, rows_per_bucket: int = MOST_ROWS,
                    rank: str = "rank") -> DataFrame:
    """1-based rank by descending score, then key, over all rows of each query; rows without a score come last."""
    order = [F.col(score).desc_nulls_last(), F.col(key).asc_nulls_first()]
    rows = with_buckets(df, [query], order, rows_per_bucket)
    counts = rows.groupBy(query, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    above = W.partitionBy(query).orderBy("_bucket")  # a row per bucket
    offsets = counts.select(query, "_bucket", (F.sum("_n").over(above) - F.col("_n")).alias("_above"))
    inner = W.partitionBy(query, "_bucket").orderBy(*order)
    return (join_null_safe(rows, offsets, [query, "_bucket"])
            .withColumn(rank, F.row_number().over(inner) + F.col("_above"))
            .drop("_bucket", "_above"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                rows_per_bucket: int = MOST_ROWS) -> DataFrame:
    """Running total per key in the given order, nulls first."""
    sequence = [F.col(c).asc_nulls_first() for c in order]
    rows = with_buckets(df, keys, sequence, rows_per_bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # a row per bucket
    offsets = totals.select(*keys, "_bucket", F.sum("_total").over(before).alias("_before"))
    inner = W.partitionBy(*keys, "_bucket").orderBy(*sequence).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(value).over(inner)
    return (join_null_safe(rows, offsets, [*keys, "_bucket"])
            .withColumn(out, F.coalesce(total + F.col("_before"), total, F.col("_before")))
            .drop("_bucket", "_before"))


def asof_last(events: DataFrame, facts: DataFrame, keys: list[str], ts: str, within: int | None = None,
              rows_per_bucket: int = MOST_ROWS) -> DataFrame:
    """Every event with `last`, the latest fact of its key at or before its time (and no more than `within` earlier), or null.

    Both sides run in one sequence per key, facts first where times are equal and the greatest fact last; a
    bucket takes what is known before it from one row per bucket. Facts without a time are left out; null keys are keys.
    """
    fact = F.struct(ts, *[c for c in facts.columns if c not in (*keys, ts)])
    own = F.struct(*[c for c in events.columns if c not in (*keys, ts)])
    both = (events.select(*keys, ts, F.lit(1).alias("_side"), own.alias("_event")).unionByName(
        facts.filter(F.col(ts).isNotNull()).select(*keys, ts, F.lit(0).alias("_side"), fact.alias("_fact")), allowMissingColumns=True))
    order = [F.col(ts).asc_nulls_first(), F.col("_side"), F.col("_fact").asc_nulls_first()]
    rows = with_buckets(both, keys, order, rows_per_bucket)
    ends = rows.groupBy(*keys, "_bucket").agg(F.max("_fact").alias("_end"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # a row per bucket
    carried = ends.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inner = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = join_null_safe(rows, carried, [*keys, "_bucket"]).withColumn(
        "last", F.coalesce(F.last("_fact", ignorenulls=True).over(inner), F.col("_carry"))).filter("_side = 1")
    fits = F.col(ts).isNotNull() if within is None else F.col(ts) - F.col(f"last.{ts}") <= within
    return known.select(*keys, ts, "_event.*", F.when(fits, F.col("last")).alias("last"))


def tied_rank(df: DataFrame, query: str, score: str, key: str, eps: float = 1e-7,
              limit: int | None = None, rank: str = "tied_rank") -> DataFrame:
    """Rows within eps of the previous row share the rank of the first of their run."""
    order = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))
    position = df.withColumn("_rn", F.row_number().over(order))
    if limit is not None:
        position = position.filter(F.col("_rn") <= limit)
    previous = F.lag(score).over(order)
    fresh = previous.isNull() | (F.abs(F.col(score) - previous) > eps)
    marked = position.withColumn("_start", F.when(fresh, F.col("_rn")))
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (marked.withColumn(rank, F.last("_start", ignorenulls=True).over(running).cast("bigint"))
            .drop("_rn", "_start"))


def relative_margin(df: DataFrame, query: str, score: str) -> DataFrame:
    """(first - second) / max(|first|, 1) per query; 1 where there is only one row."""
    best = df.groupBy(query).agg(F.max(score).alias("first"), F.count(F.lit(1)).alias("n"),
                                 F.count_if(F.lit(True)).alias("_all"))
    # The runner-up is the best of the rest; a repeated best score is its own runner-up.
    rest = (df.join(best.select(query, "first"), query)
            .groupBy(query).agg(F.count_if(F.col(score) == F.col("first")).alias("ties"),
                                F.max(F.when(F.col(score) < F.col("first"), F.col(score)))
                                .alias("_below")))
    second = F.when(F.col("ties") > 1, F.col("first")).otherwise(F.col("_below"))
    margin = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(
        (F.col("first") - second) / F.greatest(F.abs("first"), F.lit(1.0)))
    return best.drop("_all").join(rest, query).select(query, "first", margin.alias("margin"))


def top1_gap(df: DataFrame, query: str, score: str, rank: str = "rank") -> DataFrame:
    """Best-ranked score minus the highest of the other scores."""
    first = F.max(F.when(F.col(rank) == 1, F.col(score)))
    others = F.max(F.when(F.col(rank) > 1, F.col(score)))
    return df.groupBy(query).agg((first - others).alias("top1_gap"))


def gap_to_best(df: DataFrame, query: str, score: str, out: str = "gap_to_best") -> DataFrame:
    best = df.groupBy(query).agg(F.max(score).alias("_best"))
    return df.join(best, query).withColumn(out, F.col(score) - F.col("_best")).drop("_best")


def keep_within(df: DataFrame, keys: list[str], score: str, tie: str, delta: float,
                limit: int) -> DataFrame:
    """At most `limit` rows per key, none further than delta below the best."""
    window = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return (df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= limit)
            .withColumn("_best", F.first(score).over(window))
            .filter(F.col(score) >= F.col("_best") - delta).drop("_rn", "_best"))


def near_tie(df: DataFrame, query: str, score: str, max_gap: float, rank: str = "rank") -> DataFrame:
    """Shortlist rows whose gap to the first-ranked row lies in [0, max_gap]."""
    first = df.filter(F.col(rank) == 1).select(query, F.col(score).alias("_first"))
    gap = F.col("_first") - F.col(score)
    return df.join(first, query).withColumn("gap", gap).filter(gap.between(0, max_gap)).drop("_first")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order columns of every key (combines map-side)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def preserve_first_ts(log: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Latest payload of every key, stamped with the key's first timestamp."""
    rest = [c for c in log.columns if c not in (*keys, ts)]
    return log.groupBy(*keys).agg(
        F.min(ts).alias(ts), F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row")
    ).select(*keys, ts, "_row.*")


def page(df: DataFrame, order: list, number: int, per_page: int) -> DataFrame:
    """One page in the given order, with the total and whether more rows follow."""
    number, per_page = max(number, 1), max(per_page, 1)
    offset = (number - 1) * per_page
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(offset).limit(per_page)
    window = W.orderBy(*order)  # at most one page of rows
    return (rows.withColumn("position", F.row_number().over(window) + offset)
            .withColumn("total", total)
            .withColumn("has_more", F.lit(offset) + F.count(F.lit(1)).over(W.partitionBy()) < F.col("total"))
            .withColumn("position", F.col("position").cast("bigint")))


def stable_triggers(df: DataFrame, key: str, ts: str, good: Column, overlaps: Column, frames: int = 3,
                    gap: int = 400, rearm: int = 1500, rows_per_bucket: int = MOST_ROWS) -> DataFrame:
    """First row of every armed episode where `frames` consecutive good rows were seen.

    A run restarts on a bad row, on a good row that does not overlap the one
    before, or after a pause longer than `gap`; a bad row later than `rearm`
    after the last good row arms the trigger again. A key's rows are worked on
    per time bucket; what a bucket needs from those before it is carried over
    from one summary row per bucket.
    """
    flagged = df.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_over", overlaps)
    rows = with_buckets(flagged, [key], [F.col(ts).asc_nulls_first()], rows_per_bucket)
    place = [key, "_bucket"]
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy(*place).orderBy(ts)
    past = inner.rowsBetween(W.unboundedPreceding, -1)
    running = inner.rowsBetween(W.unboundedPreceding, W.currentRow)

    seen = F.when(F.col("_good"), F.col(ts))
    carried = rows.groupBy(*place).agg(F.max(seen).alias("_g"), F.max_by("_good", ts).alias("_l")).select(
        *place, F.max("_g").over(earlier).alias("_carry"), F.last("_l").over(earlier).alias("_carry_good"))
    known = join_null_safe(rows, carried, place).withColumn(
        "_last", F.coalesce(F.max(seen).over(past), "_carry", F.lit(0))).withColumn(
        "_before", F.coalesce(F.lag("_good").over(inner), "_carry_good", F.lit(False)))
    pause = F.col(ts) - F.col("_last")
    starts = F.col("_good") & (~F.col("_before") | ~F.col("_over") | (pause > gap))
    arms = ~F.col("_good") & (pause > rearm)
    marks = known.select(*place, ts, "_good", starts.alias("_starts"), arms.alias("_arms"))
    counted = {"_run": "_starts", "_episode": "_arms", "_goods": "_good"}
    totals = marks.groupBy(*place).agg(*[F.count_if(F.col(flag)).alias(flag) for flag in counted.values()])
    offsets = totals.select(*place, *[F.coalesce(F.sum(flag).over(earlier), F.lit(0)).alias(name + "_offset")
                                      for name, flag in counted.items()])
    placed = join_null_safe(marks, offsets, place)
    for name, flag in counted.items():
        placed = placed.withColumn(name, F.count_if(F.col(flag)).over(running) + F.col(name + "_offset"))
    firsts = placed.filter("_starts").select(key, "_run", F.col("_goods").alias("_first"))
    fired = join_null_safe(placed.filter("_good"), firsts, [key, "_run"]).filter(
        F.col("_goods") - F.col("_first") + 1 >= frames)
    return fired.groupBy(key, "_episode").agg(F.min(ts).alias(ts)).select(key, ts)
