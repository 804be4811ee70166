"""Streams cut into files with late rows agree with what all rows at once give, and their state ends."""
import random

import pytest
from pyspark.sql import functions as F

from catmatch import fixed_values as fv
from catmatch.operators import ranking as rk, vector_blocks as vb
from catmatch.streaming import event_order as eo, jobs as js

HOUR = 3_600_000_000
KINDS = ["pending", "processing", "done", "failed", "unheard", None]


def files(spark, tmp_path, parts, schema, name="in"):
    """A stream of one file per part, in the order of the parts."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name / f"p={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))


def late_log(seed, n=900, keys=4, hours=60):
    """Rows of three files; a third of each file's rows comes a file later, within a delay of `hours`."""
    rng = random.Random(seed)
    rows = [(rng.choice([*range(keys), None]), rng.randrange(hours * HOUR), i, rng.choice(KINDS)) for i in range(n)]
    parts = [[], [], []]
    for row in rows:
        at = min(2, row[1] * 3 // (hours * HOUR))
        parts[min(2, at + (rng.random() < 0.33))].append(row)
    end = [(99, (hours * 3) * HOUR, n, "pending")]  # pushes the watermark behind all other rows
    return rows, [*parts, end]


def by_hand(rows):
    out = {}
    for key, _, _, change in sorted(rows, key=lambda r: (r[1], r[2])):
        status, valid, refused = out.get(key, ("", 0, 0))
        ok = (status, change) in js.JOB_TRANSITIONS
        out[key] = (change if ok else status, valid + ok, refused + (not ok))
    return out


def test_job_states_of_files_with_late_rows(spark, tmp_path):
    rows, parts = late_log(3)
    stream = files(spark, tmp_path, parts, "job int, us long, tie long, status string").withColumn("event_time", F.timestamp_micros("us"))
    found = eo.job_state_stream(stream, str(tmp_path / "out"), "job", delay="60 hours")
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == by_hand(rows)


def test_job_states_in_batch_by_any_window(spark):
    rows, _ = late_log(4, n=400, hours=2000)
    log = spark.createDataFrame(rows, "job int, us long, tie long, status string").withColumn("event_time", F.timestamp_micros("us"))
    for every in ("10 minutes", "1 day", "400 days"):
        found = eo.job_states(eo.job_moves(log, "job", every=every), "job")
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == by_hand(rows)
    assert eo.job_states(eo.job_moves(log.limit(0), "job"), "job").collect() == []


def test_stable_triggers_of_files_with_late_rows(spark, tmp_path):
    rng = random.Random(8)
    rows, ts = [], 0
    for _ in range(600):
        ts += rng.choice([100, 150, 300, 500, 1700])
        rows.append((rng.randrange(3), ts, rng.random() < 0.8, rng.random() < 0.9))
    parts = [[], [], []]
    for i, row in enumerate(rows):
        parts[min(2, i // 200 + (rng.random() < 0.3))].append(row)
    schema = "k int, ts long, good boolean, overlaps boolean"
    stream = files(spark, tmp_path, [*parts, [(99, ts * 9, False, False)]], schema).withColumn("event_time", F.timestamp_millis("ts"))
    found = eo.stable_trigger_stream(stream, str(tmp_path / "out"), "k", "5 seconds", f"{ts} milliseconds")
    batch = rk.stable_triggers(spark.createDataFrame(rows, schema), "k", "ts", F.col("good"), F.col("overlaps"))
    expected = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, found.collect())) == expected and expected


def state_rows(query):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("which", ["beats", "awards"])
def test_state_shrinks_after_silence(spark, tmp_path, which):
    many = [(k, k * 1_000_000, "not_in_catalog" if k % 2 else fv.CONFIRMED_STATUSES[0]) for k in range(500)]
    parts = [many, [(0, 50 * HOUR, fv.CONFIRMED_STATUSES[0])], [(0, 100 * HOUR, fv.CONFIRMED_STATUSES[0])]]
    stream = files(spark, tmp_path, parts, "k int, us long, status string").withColumn("ts", F.timestamp_micros("us"))
    if which == "beats":
        run, mode = eo.beats_by_window(stream, "k", "ts", "1 hour", "1 hour", F.col("k") % 2 == 0), "update"
    else:
        run, mode = eo.award_within(stream, ["k"], "ts", "1 hour"), "append"
    query = (run.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    sizes = state_rows(query)
    assert max(sizes) >= 250 and sizes[-1] <= 2


def test_liveness_and_awards_over_files(spark, tmp_path):
    status = fv.CONFIRMED_STATUSES[0]
    parts = [[(1, 5 * HOUR, status), (2, HOUR, status), (None, HOUR, status)], [(1, 4 * HOUR, status), (1, 90 * HOUR, "not_in_catalog")],
             [(1, 95 * HOUR, status), (2, 94 * HOUR, status), (3, 96 * HOUR, "not_in_catalog")]]
    schema = "k int, us long, status string"
    read = lambda: files(spark, tmp_path, [], schema).withColumn("ts", F.timestamp_micros("us"))
    files(spark, tmp_path, parts, schema)
    seen = eo.liveness(read(), str(tmp_path / "beats"), "k", "ts", "1 hour", "1 hour", F.col("status") == status)
    hours = lambda c: F.unix_micros(c) / HOUR
    assert {tuple(r) for r in seen.select("k", hours("last_seen"), hours("last_fresh")).collect()} == {
        (1, 95.0, 95.0), (2, 94.0, 94.0), (3, 96.0, None), (None, 1.0, 1.0)}
    given = eo.awards(read(), str(tmp_path / "awards"), ["k"], "ts", "1 hour")
    assert sorted(map(str, given.collect())) == sorted(f"Row(k={k}, points={fv.POINTS_SCAN})" for k in (1, 2, None))


def test_scans_over_two_files_get_one_ranking(spark, tmp_path):
    rng = random.Random(5)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    gallery = [(i // 2, i, rng.choice(["body", "label", "flat", "reference"]), [f"s{i // 2}"], vector()) for i in range(240)]
    views = [(q, q * 10 + n, rng.choice(["body", "label", "flat", "reference"]), vector()) for q in range(12) for n in range(4)]
    # Scan 100 has a whole image in the first file and its body only in the second.
    parts = [[v for v in views if v[1] % 2], [v for v in views if not v[1] % 2]]
    parts[0].append((100, 1001, "reference", vector()))
    parts[1].append((100, 1002, "body", vector()))
    schema = "query_id long, view_id long, family string, vector array<double>"
    blocks = vb.build_blocks(spark.createDataFrame(gallery, "record_id long, view_id long, family string, slugs array<string>, vector array<double>"), block_views=32)
    found = eo.match_views(files(spark, tmp_path, parts, schema), blocks, str(tmp_path / "out"), 5)
    whole = vb.branch_rankings(spark.createDataFrame(parts[0] + parts[1], schema), None, 5, blocks=blocks)
    expected = sorted(map(tuple, whole.select(*found.columns).collect()))
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 100
