"""Streams in event-time order with state that ends with the watermark.

Rows wait in windows of their key; a window leaves, sorted, once the watermark has passed its end, whatever
files its rows came in. What must be followed in order is then composed: a window's changes become one small
function, and functions compose, so a key's history is folded in parallel and no state outlives the delay.
Rows later than the delay are dropped, as are rows without a time; null keys are keys.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catmatch import fixed_values as fv
from catmatch.operators import vector_blocks as vb
from catmatch.streaming.jobs import JOB_TRANSITIONS, NO_FRAMES, _ordered, mark_shots, run_batches, run_to_folder

STATES = sorted({s for change in JOB_TRANSITIONS for s in change})


def in_order(rows: DataFrame, keys: list[str], ts: str, tie: list[str], every: str, delay: str) -> DataFrame:
    """The rows of every key by time and tie: no micro-batch holds a row older than one before it had."""
    return _windows(rows, keys, ts, tie, every, delay).select(*keys, F.explode("rows").alias("_r")).select(*keys, "_r.*")


def _windows(rows: DataFrame, keys: list[str], ts: str, tie: list[str], every: str, delay: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, ts, *tie)]
    held = rows.withWatermark(ts, delay).groupBy(*keys, F.window(ts, every).alias("window"))
    return held.agg(F.sort_array(F.collect_list(F.struct(ts, *tie, *others))).alias("rows"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which value state needs; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# ------------------------------------------------------------ triggers
class _Shots(StatefulProcessor):
    """One summary of all frames before, per key."""

    def __init__(self, key: str, n: int, gap: int, rearm: int):
        self.key, self.rule = key, (n, gap, rearm)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "newest bigint, open_run bigint, due boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = _ordered(rows, ["ts"])
        if len(frames):
            before = self.before.get()  # None at first; to ask would be another call for every key
            shots, after = mark_shots(frames, NO_FRAMES if before is None else tuple(before), *self.rule)
            self.before.update(after)
            if len(shots):
                yield pd.DataFrame({self.key: [key[0]] * len(shots), "ts": shots.to_numpy()})

    def close(self) -> None:
        pass


def stable_trigger_stream(frames: DataFrame, folder: str, key: str, every: str, delay: str, n: int = 3, gap: int = 400, rearm: int = 1500) -> DataFrame:
    """(key, ts) of the shots of a stream with key, event_time, ts, good and overlaps, whatever files its frames came in.

    Frames leave the state with their window; three numbers a key stay.
    """
    ordered = in_order(frames, [key], "event_time", ["ts"], every, delay).select(key, "ts", "good", "overlaps")
    kind = frames.schema[key].dataType.simpleString()
    shots = ordered.groupBy(key).transformWithStateInPandas(
        _Shots(key, n, gap, rearm), f"{key} {kind}, ts bigint", "append", "none")
    with rocksdb(frames.sparkSession):
        return run_to_folder(shots, folder)


# ------------------------------------------------------------ job states
def _state(status: Column, valid: Column | int = 0, refused: Column | int = 0) -> Column:
    whole = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    return F.struct(status.alias("status"), whole(valid).alias("valid"), whole(refused).alias("refused"))


def _names() -> Column:
    return F.array(*[F.lit(s) for s in STATES])


def moves_of(rows: Column) -> Column:
    """What ordered changes do to a job: for each of STATES the state it ends in, with valid and refused changes."""
    allowed = [f"{a}>{b}" for a, b in sorted(JOB_TRANSITIONS)]

    def change(state, row):
        ok = F.coalesce(F.concat(state["status"], F.lit(">"), row["status"]).isin(allowed), F.lit(False))
        return _state(F.when(ok, row["status"]).otherwise(state["status"]),
                      state["valid"] + ok.cast("bigint"), state["refused"] + (~ok).cast("bigint"))

    return F.transform(_names(), lambda s: F.aggregate(rows, _state(s), change))


def _after(state: Column, moves: Column) -> Column:
    then = F.element_at(moves, F.array_position(_names(), state["status"]).cast("int"))
    return _state(then["status"], state["valid"] + then["valid"], state["refused"] + then["refused"])


def compose_moves(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, moves): the pieces of every key, composed in order of their start."""
    listed = pieces.groupBy(*keys).agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "moves"))).alias("_l"))
    none = F.transform(_names(), lambda s: _state(s))
    whole = F.aggregate("_l", none, lambda m, piece: F.transform(m, lambda s: _after(s, piece["moves"])))
    return listed.select(*keys, "start", whole.alias("moves"))


def job_moves(log: DataFrame, key: str, ts: str = "event_time", tie: str = "tie", every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(key, start, moves) of every window of a log with key, event time, tie and status; a batch log is taken whole."""
    held = _windows(log.select(key, ts, tie, "status"), [key], ts, [tie], every, delay)
    return held.select(key, F.col("window.start").alias("start"), moves_of(F.col("rows")).alias("moves"))


def job_states(pieces: DataFrame, key: str) -> DataFrame:
    """(key, status, valid, refused) after all pieces: by months first, so a long history is no single list."""
    months = compose_moves(pieces.withColumn("_month", F.date_trunc("month", "start")), [key, "_month"])
    whole = compose_moves(months.drop("_month"), [key])
    end = _after(_state(F.lit("")), F.col("moves"))
    return whole.select(key, end.alias("_s")).select(key, "_s.status", "_s.valid", "_s.refused")


def job_state_stream(log: DataFrame, folder: str, key: str, **options) -> DataFrame:
    """Follow a log into a folder of composed windows and read the states of all windows that have ended."""
    return job_states(run_to_folder(job_moves(log, key, **options), folder), key)


# ------------------------------------------------------------ liveness and awards
def beats_by_window(beats: DataFrame, key: str, ts: str, every: str, delay: str, fresh: Column) -> DataFrame:
    """Last beat and last fresh-version beat per key and window; a silent key's windows leave the state."""
    return beats.withWatermark(ts, delay).groupBy(key, F.window(ts, every).alias("window")).agg(
        F.max(ts).alias("last_seen"), F.max(F.when(fresh, F.col(ts))).alias("last_fresh"))


def liveness(beats: DataFrame, folder: str, key: str, ts: str, every: str, delay: str, fresh: Column) -> DataFrame:
    """(key, last_seen, last_fresh) so far: every micro-batch writes the windows it changed, readers take the latest."""
    run_batches(beats_by_window(beats, key, ts, every, delay, fresh).drop("window"), folder, lambda batch: batch, "update")
    return beats.sparkSession.read.parquet(folder + "/rows").groupBy(key).agg(
        F.max("last_seen").alias("last_seen"), F.max("last_fresh").alias("last_fresh"))


def award_within(scans: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Keys with a confirmed scan; repeats within the delay are dropped by the stream, older ones leave its state."""
    confirmed = scans.filter(F.col("status").isin(fv.CONFIRMED_STATUSES))
    return confirmed.select(*keys, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys).select(*keys)


def awards(scans: DataFrame, folder: str, keys: list[str], ts: str, delay: str) -> DataFrame:
    """(keys, points): one award a key, however far its scans lie apart: readers drop what the stream let through again."""
    written = run_to_folder(award_within(scans, keys, ts, delay), folder)
    return written.dropDuplicates(keys).withColumn("points", F.lit(fv.POINTS_SCAN))


# ------------------------------------------------------------ matching
def match_views(scans: DataFrame, blocks: vb.GalleryBlocks, folder: str, limit: int = 10) -> DataFrame:
    """Branch rankings of scans whose views may come in any number of micro-batches, equal to those of all views at once.

    A card among the best of a scan is among the best of the micro-batch that has its winning view, so lists of `limit`
    merge to the true list. Whole images are ranked apart: they count where no body view of their scan ever comes.
    """
    def each(batch: DataFrame) -> DataFrame:
        whole = F.coalesce(F.col("family") == "reference", F.lit(False))
        own, stand_in = (vb.branch_rankings(batch.filter(part), None, limit, blocks=blocks) for part in (~whole, whole))
        bodies = batch.filter("family = 'body'").select("query_id").distinct().withColumn("kind", F.lit("body"))
        ranked = own.withColumn("kind", F.lit("own")).unionByName(stand_in.withColumn("kind", F.lit("whole")))
        return ranked.drop("rank").unionByName(bodies, allowMissingColumns=True)

    run_batches(scans, folder, each)
    rows = scans.sparkSession.read.parquet(folder + "/rows").drop("batch")
    # Only whole images are looked up: the lists of the others, most of all, stay where they are.
    bodies = rows.filter("kind = 'body'").select("query_id").distinct()
    found = rows.filter("kind = 'own'").unionByName(rows.filter("kind = 'whole'").join(bodies, "query_id", "left_anti").select(*rows.columns))
    return vb.merge_rankings(found.drop("kind"), limit)
