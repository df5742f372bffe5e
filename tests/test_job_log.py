"""Job event logs (L24) and counters with tags."""

import random

import pytest
from pyspark.sql import functions as F

from feedstack.operators import job_log as J
from feedstack.operators import stats

SCHEMA = ("processing_id string, event_ts string, seq int, status string, processed_files int, failed_files int, "
          "total_reviews int, file_name string, file_list string")


def _log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


def _replay(events):
    """The state of one job, an event at a time."""
    s = {"status": None, "events": 0, "refused": 0, "start": None, "end": None, "progress": (None,) * 3, "added": [0, 0]}
    for _, at, _, status, done, failed, reviews, name, kind in events:
        s["events"] += 1
        if status is not None:
            if status in J.STATES and (s["status"] is None or status in J.JOB_TRANSITIONS.get(s["status"], [])):
                s["status"] = status
                s["start"] = at if status == "IN_PROGRESS" else s["start"]
                s["end"] = at if status in J.ENDED else s["end"]
            else:
                s["refused"] += 1
        if (done, failed, reviews) != (None, None, None):
            s["progress"] = (done, failed, reviews)
        if name is not None:
            s["added"][kind == "failed"] += 1
    return s["status"], s["events"], s["refused"], s["start"], s["end"], s["progress"], tuple(s["added"])


def _rows(rnd, n, jobs):
    out = []
    for i in range(n):
        job = rnd.choice(jobs)
        at = f"2024-01-{1 + i * 27 // n:02d} 00:00:{rnd.randrange(60):02d}"
        kind = rnd.random()
        status = rnd.choice([*J.STATES, "PAUSED"]) if kind < 0.5 else None
        progress = (rnd.randrange(9), rnd.choice([None, 1]), rnd.randrange(99)) if 0.5 <= kind < 0.7 else (None,) * 3
        name, where = (f"f{i}", rnd.choice(["processed", "failed"])) if 0.6 <= kind < 0.9 else (None, None)
        out.append((job, at, i, status, *progress, name, where))
    return out


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_equals_a_replay_event_by_event(spark, monkeypatch, bits):
    monkeypatch.setattr(J, "_BLOCK", bits)
    monkeypatch.setattr(J, "_SEGMENT", min(bits, 2))
    rows = _rows(random.Random(bits), 400, ["hot"] * 8 + ["b", "c", None])
    log = _log(spark, rows).repartition(5)
    by_job = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by_job.setdefault(r[0], []).append(r)
    got = {r.processing_id: (r.status, r.events, r.refused_moves, r.start_time and str(r.start_time), r.end_time and str(r.end_time),
                             (r.processed_files, r.failed_files, r.total_reviews), (r.added_processed, r.added_failed))
           for r in J.job_state(log).collect()}
    assert got == {job: _replay(events) for job, events in by_job.items()}
    moves = J.job_transitions(log.select("processing_id", "event_ts", "seq", "status", F.lit(7).alias("extra")))
    assert moves.columns == ["processing_id", "event_ts", "seq", "status", "extra", "previous_status", "legal"]
    seen = {(r.processing_id, r.seq): (r.previous_status, r.legal) for r in moves.collect()}
    want = {}
    for job, events in by_job.items():
        for i, e in enumerate(events):
            prev = events[i - 1][3] if i else None
            want[job, e[2]] = (prev, prev is None or e[3] in J.JOB_TRANSITIONS.get(prev, []))
    assert {k: (p, bool(v)) for k, (p, v) in seen.items()} == want


def test_one_job_with_a_million_events(spark):
    n = 1_000_000
    log = spark.range(n, numPartitions=8).select(
        F.lit("hot").alias("processing_id"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("event_ts"),
        F.col("id").alias("seq"), F.when(F.col("id") == 0, "PENDING").when(F.col("id") == 5, "IN_PROGRESS").when(
            F.col("id") == n - 3, "COMPLETED").when(F.col("id") % 4 == 0, "PENDING").alias("status"),
        F.col("id").cast("int").alias("processed_files"))
    r = J.job_state(log).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.status, r.events, r.refused_moves, r.processed_files) == ("COMPLETED", n, n // 4 - 1, n - 1)
    assert str(r.start_time) == "2024-01-01 00:00:05" and str(r.end_time) == "2024-01-12 13:46:37"
    plan = J.job_transitions(log)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(_block" in plan and "windowspecdefinition(processing_id" not in plan


def test_empty_log_and_missing_columns(spark):
    log = _log(spark, [("a", "2024-01-01 00:00:00", 1, "CANCELLED", None, None, None, None, None)]).select(
        "processing_id", "event_ts", "seq", "status")
    r = J.job_state(log).collect()[0]
    assert (r.status, r.refused_moves, r.processed_files, r.added_failed) == ("CANCELLED", 0, None, 0)
    assert J.job_state(log.filter("seq > 9")).count() == 0 and J.job_transitions(log.filter("seq > 9")).count() == 0


def test_counters_by_every_set_of_tags(spark):
    rows = [("api", {"method": "GET", "endpoint": "/a", "status": "200"}, 1), ("api", {"endpoint": "/a", "method": "PUT", "status": "200"}, 2),
            ("own", {"k": "v"}, 5), ("own", {"k": None}, 1), ("bare", None, 3), ("bare", {}, 4)]
    got = {(r.metric, r.tags): (r.n_tags, r.observations, r.total) for r in stats.meter_counters(
        spark.createDataFrame(rows, "metric string, tags map<string, string>, value long")).collect()}
    assert got == {
        ("api", "endpoint=/a,method=GET,status=200"): (3, 1, 1), ("api", "endpoint=/a,method=PUT,status=200"): (3, 1, 2),
        ("api", "endpoint=/a"): (1, 2, 3), ("api", "method=GET"): (1, 1, 1), ("api", "method=PUT"): (1, 1, 2),
        ("api", "status=200"): (1, 2, 3), ("api", ""): (0, 2, 3), ("own", "k=v"): (1, 1, 5), ("own", "k="): (1, 1, 1),
        ("own", ""): (0, 2, 6), ("bare", ""): (0, 2, 7)}
