"""The streaming twins, replayed over the event tables and compared with their batch SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from catmatch import fixed_values as fv
from catmatch.operators import vector_blocks as vb, visual as vs
from catmatch.plans.oracle_views import sql_in
from catmatch.plans.registry import query
from catmatch.plans.relational_queries import STABLE_SQL
from catmatch.plans.vector_queries import VECTOR_VIEWS, WHOLE_VIEWS
from catmatch.sources.bindings import Views
from catmatch.streaming import event_order as eo, jobs as js


class Replayed(Views):
    """The same views with the events (or another table) arriving as a stream."""

    def __init__(self, v: Views, *tables: str):
        super().__init__(v.spark, v.directory)
        self._streams = tables

    def __getattr__(self, name):
        if name in self.__dict__.get("_streams", ()):
            return js.replay(self.spark, self.directory, name)
        return super().__getattr__(name)


@query("match_stream", "R1", """
    SELECT query_id, slug, round(score, 9) AS score, rank FROM (SELECT query_id, slug, score, row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC, slug) AS rank FROM rrf) WHERE rank <= 5""", VECTOR_VIEWS)
def match_stream(v):
    gallery, cards = v.gallery_views, v.bench_cards

    def match(batch):
        return vs.visual_search(batch, gallery, cards, 10).filter("rank <= 5").select("query_id", "slug", "score", "rank")

    found = js.match_stream(Replayed(v, "embeddings").query_views, match, js.scratch(v.spark, "match"))
    return found.withColumn("score", F.round("score", 9))


JOB_STATE_SQL = """
    SELECT user_id, s.status AS status, s.valid AS valid, s.refused AS refused FROM (SELECT user_id, list_reduce(list_prepend(
        {'status': '', 'valid': 0::BIGINT, 'refused': 0::BIGINT}, list({'status': status, 'valid': 0::BIGINT, 'refused': 0::BIGINT} ORDER BY ts, event_id)),
      lambda a, x: CASE WHEN (a.status || '>' || x.status) IN ('>pending', 'pending>processing', 'pending>failed', 'processing>done', 'processing>failed', 'done>pending', 'failed>pending')
        THEN {'status': x.status, 'valid': a.valid + 1, 'refused': a.refused} ELSE {'status': a.status, 'valid': a.valid, 'refused': a.refused + 1} END) AS s
    FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status FROM events)
    GROUP BY user_id)"""


def job_log(v):
    kind = F.col("event_type")
    status = (F.when(kind == "signup", "pending").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("processing"))
    return Replayed(v, "events").events.select(
        "user_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("tie"), status.alias("status"))


@query("job_state", "R2", JOB_STATE_SQL)
def job_state(v):
    log = job_log(v).select("user_id", F.unix_micros("event_time").alias("ts"), "tie", "status")
    states = js.job_state(log, "user_id")
    folder = js.scratch(v.spark, "job-state")
    js.run_batches(states, folder, lambda batch: batch, "update")
    rows = v.spark.read.parquet(folder + "/rows")
    return js.latest_by(rows.select("user_id", "batch", "status", "valid", "refused"), ["user_id"], ["batch"]).drop("batch")


@query("liveness_stream", "R3", """
    SELECT user_id, max(ts) AS last_seen, bool_or(ts > (SELECT max(ts) FROM scan_log) - 86400000000 AND item_id::INT % 2 = 0) AS ready
    FROM scan_log GROUP BY user_id""")
def liveness_stream(v):
    beats = Replayed(v, "events").events.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    running = js.latest_beats(beats, "user_id", "ts", "1 minute", F.col("k") % 2 == 0)
    folder = js.scratch(v.spark, "liveness")
    js.run_batches(running, folder, lambda batch: batch, "update")
    rows = v.spark.read.parquet(folder + "/rows").groupBy("user_id").agg(
        F.max("last_seen").alias("last_seen"), F.max("last_fresh").alias("last_fresh"))
    as_of = v.events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    return rows.select("user_id", F.unix_micros("last_seen").alias("last_seen"), F.coalesce(
        F.unix_micros("last_fresh") > as_of - 86_400_000_000, F.lit(False)).alias("ready"))


@query("award_once", "R4", f"""
    SELECT DISTINCT user_id, item_id, 10 AS points FROM scan_log WHERE status IN {sql_in(fv.CONFIRMED_STATUSES)}""")
def award_once(v):
    awards = js.award_once(Replayed(v, "events").scan_log, ["user_id", "item_id"])
    return js.run_to_folder(awards, js.scratch(v.spark, "awards"))


@query("stable_trigger", "R5", STABLE_SQL.replace(
    "scan_events", "(SELECT user_id, epoch_us(ts) AS ts, event_type, value FROM events)"))
def stable_trigger(v):
    frames = Replayed(v, "events").events.select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        (F.col("event_type") != "error").alias("good"), (F.col("value") < 60).alias("overlaps"))
    return js.run_to_folder(js.stable_trigger(frames, "user_id", 3, 43_200_000_000, 7_200_000_000),
                            js.scratch(v.spark, "stable"))


DEADLINE_SQL = """
    SELECT job, started FROM (SELECT user_id || ':' || item_id AS job, min(CASE WHEN status = 'legacy' THEN ts END) AS started,
      min(CASE WHEN status = 'user_confirmed' THEN ts END) AS finished FROM scan_log GROUP BY job)
    WHERE started IS NOT NULL AND coalesce(finished - started > 86400000000, true)
      AND (started + 86400000000) // 1000 + 1 <= (SELECT max(ts) // 1000 FROM scan_log)"""


def job_events(v):
    return Replayed(v, "events").scan_log.select(
        F.concat_ws(":", "user_id", "item_id").alias("job"), F.timestamp_micros("ts").alias("event_time"),
        (F.col("status") == "legacy").alias("is_start"), (F.col("status") == "user_confirmed").alias("is_finish"))


@query("deadline_miss_stream", "R6", DEADLINE_SQL)
def deadline_miss_stream(v):
    return js.deadline_misses(job_events(v), js.scratch(v.spark, "deadline"), "job", 86_400_000_000, delay="0 seconds")


@query("deadline_miss_late", "R6", DEADLINE_SQL + " - 3600000")
def deadline_miss_late(v):
    """A miss is told an hour later, when rows up to an hour late have come."""
    return js.deadline_misses(job_events(v), js.scratch(v.spark, "deadline"), "job", 86_400_000_000, delay="1 hour")


@query("history_sink", "R7", """
    SELECT user_id, item_id, arg_max(scan_id, (ts, scan_id)) AS scan_id, arg_max(status, (ts, scan_id)) AS status FROM scan_log GROUP BY user_id, item_id""")
def history_sink(v):
    log = Replayed(v, "events").scan_log.select("user_id", "item_id", "ts", "scan_id", "status")
    saved = js.history_sink(log, js.scratch(v.spark, "history"), ["user_id", "item_id"], ["ts", "scan_id"])
    return saved.select("user_id", "item_id", "scan_id", "status")


# What has left a stream of hourly windows and one hour's delay when all files are read.
SEALED = "(SELECT * FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR)"


@query("job_state_ordered", "R2", JOB_STATE_SQL.replace("FROM events", f"FROM {SEALED}"))
def job_state_ordered(v):
    return eo.job_state_stream(job_log(v), js.scratch(v.spark, "job-moves"), "user_id")


@query("stable_trigger_ordered", "R5", STABLE_SQL.replace(
    "scan_events", f"(SELECT user_id, epoch_us(ts) AS ts, event_type, value FROM {SEALED})"))
def stable_trigger_ordered(v):
    frames = Replayed(v, "events").events.withColumn("event_time", F.col("ts").cast("timestamp")).select(
        "user_id", "event_time", F.unix_micros("event_time").alias("ts"),
        (F.col("event_type") != "error").alias("good"), (F.col("value") < 60).alias("overlaps"))
    return eo.stable_trigger_stream(frames, js.scratch(v.spark, "ordered"), "user_id", "1 hour", "1 hour", 3, 43_200_000_000, 7_200_000_000)


@query("liveness_bounded", "R3", """
    SELECT user_id, max(ts) AS last_seen, max(CASE WHEN item_id::INT % 2 = 0 THEN ts END) AS last_fresh FROM scan_log GROUP BY user_id""")
def liveness_bounded(v):
    beats = Replayed(v, "events").events.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    seen = eo.liveness(beats, js.scratch(v.spark, "beats"), "user_id", "ts", "1 day", "1 hour", F.col("k") % 2 == 0)
    return seen.select("user_id", *[F.unix_micros(c).alias(c) for c in ("last_seen", "last_fresh")])


@query("award_once_bounded", "R4", f"""
    SELECT DISTINCT user_id, item_id, 10 AS points FROM scan_log WHERE status IN {sql_in(fv.CONFIRMED_STATUSES)}""")
def award_once_bounded(v):
    scans = Replayed(v, "events").scan_log.withColumn("event_time", F.timestamp_micros("ts"))
    return eo.awards(scans, js.scratch(v.spark, "award"), ["user_id", "item_id"], "event_time", "1 hour")


@query("match_stream_merged", "R1", """
    SELECT query_id, branch, slug, rank, round(cosine, 6) AS cosine, query_view::BIGINT AS query_view, gallery_view::BIGINT AS gallery_view FROM branch_list""", WHOLE_VIEWS)
def match_stream_merged(v):
    blocks = vb.build_blocks(v.card_views)
    found = eo.match_views(Replayed(v, "documents").document_views, blocks, js.scratch(v.spark, "views"), 10)
    return found.select("query_id", "branch", "slug", "rank", F.round("cosine", 6).alias("cosine"), "query_view", "gallery_view")
