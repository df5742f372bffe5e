import pytest
from pyspark.sql import functions as F

from feedstack.operators import job_log, ledger, query, stats


def _ledger(spark, statuses):
    rows = [(i, f"k{i}.jl", "e", 10, s, "Agoda", "2024-01-01 00:00:00", "2024-01-01 00:00:00") for i, s in enumerate(statuses)]
    df = spark.createDataFrame(rows, "id long, s3_key string, etag string, file_size long, processing_status string, "
                                     "provider string, created_at string, processing_started_at string")
    return df.withColumns({"created_at": F.col("created_at").cast("timestamp_ntz"),
                           "processing_started_at": F.col("processing_started_at").cast("timestamp_ntz")})


def test_statistics_200_files(spark):
    lf = _ledger(spark, ["COMPLETED"] * 170 + ["FAILED"] * 15 + ["PENDING"] * 15)
    r = stats.file_statistics(lf).collect()[0]
    assert (r.total_files, r.success_rate, r.failure_rate) == (200, 85.0, 7.5)


def test_stuck_files_reset(spark):
    lf = _ledger(spark, ["IN_PROGRESS", "IN_PROGRESS", "COMPLETED"])
    out = ledger.reset_stuck(lf, "2024-01-01 03:00:00").collect()
    assert len(out) == 2 and all(r.processing_status == "FAILED" for r in out)


def _events(spark):
    rows = [(1, "a", "e", "IN_PROGRESS", "2024-01-01 00:00:00"), (2, "a", "e", "COMPLETED", "2024-01-01 01:00:00"),
            (3, "b", "e", "PENDING", "2024-01-01 00:00:00"), (4, "b", "e", "IN_PROGRESS", "2024-01-01 00:00:00"),
            (5, "c", "e", "COMPLETED", "2024-01-01 00:00:00"), (6, "c", "e", "FAILED", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "id long, s3_key string, etag string, processing_status string, updated_at string")
    t = F.col("updated_at").cast("timestamp_ntz")
    return df.withColumns({"updated_at": t, "processing_started_at": t, "records_processed": F.lit(0), "error_message": F.lit("x")})


def test_ledger_operators_read_the_current_state(spark):
    ev = _events(spark)
    state = {r.s3_key: r.processing_status for r in ledger.current_state(ev).collect()}
    assert state == {"a": "COMPLETED", "b": "IN_PROGRESS", "c": "FAILED"}
    out = ledger.reset_stuck(ev, "2024-01-01 05:00:00")
    assert [(r.s3_key, r.id) for r in out.collect()] == [("b", 5)]
    again = {r.s3_key: r.processing_status for r in ledger.current_state(ev.unionByName(out)).collect()}
    assert again == {"a": "COMPLETED", "b": "FAILED", "c": "FAILED"}
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "s3_key string")
    assert sorted(r.s3_key for r in ledger.filter_unprocessed(keys, ev).collect()) == ["b", "c", "z"]
    assert [r.s3_key for r in ledger.is_processed(keys, ev).collect()] == ["a"]
    assert [r.s3_key for r in ledger.unknown_keys(ev, keys).collect()] == ["z"]


def test_mark_makes_one_event_for_each_file(spark):
    ev = _events(spark)
    keys = spark.createDataFrame([("b", 7), ("b", 7), ("z", 1)], "s3_key string, records_processed int")
    done = ledger.mark(ev, keys, "COMPLETED", "2024-01-02 00:00:00").collect()
    assert [(r.s3_key, r.id, r.processing_status, r.records_processed, r.error_message) for r in done] == [("b", 5, "COMPLETED", 7, None)]
    failed = ledger.mark(ev, keys, "FAILED", "2024-01-02 00:00:00").collect()
    assert [(r.processing_status, r.error_message) for r in failed] == [("FAILED", None)]


def test_paging(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00") for i in range(1, 6)], "id long, review_date string") \
        .withColumn("review_date", F.col("review_date").cast("timestamp_ntz"))
    page = query.page(df, 0, 3).collect()
    info = query.page_info(df, 3).collect()[0]
    assert [r.id for r in page] == [5, 4, 3]
    assert (info.total_elements, info.total_pages) == (5, 2)
    nxt = query.page_after(df, "2024-01-03 00:00:00", 3, 3).collect()
    assert [r.id for r in nxt] == [2, 1]


def test_job_transitions_flag_illegal_moves(spark):
    rows = [("j1", "2024-01-01 00:00:00", 0, "PENDING"), ("j1", "2024-01-01 00:01:00", 1, "IN_PROGRESS"),
            ("j1", "2024-01-01 00:02:00", 2, "COMPLETED"), ("j1", "2024-01-01 00:03:00", 3, "IN_PROGRESS"),
            ("j2", "2024-01-01 00:00:00", 0, "PENDING"), ("j2", "2024-01-01 00:00:00", 1, "CANCELLED")]
    ev = spark.createDataFrame(rows, "processing_id string, event_ts string, seq int, status string") \
        .withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    out = {(r.processing_id, r.seq): r.legal for r in job_log.job_transitions(ev).collect()}
    assert out == {("j1", 0): True, ("j1", 1): True, ("j1", 2): True, ("j1", 3): False,
                   ("j2", 0): True, ("j2", 1): True}


def test_first_page_and_rows_without_a_date(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-02 00:00:00"), (3, None), (4, "2024-01-03 00:00:00")],
                               "id long, review_date string").withColumn("review_date", F.col("review_date").cast("timestamp_ntz"))
    assert [r.id for r in query.page_after(df, size=2).collect()] == [1, 3]
    assert [r.id for r in query.page_after(df, None, 1, 2).collect()] == [3, 4]
    assert [r.id for r in query.page_after(df, "2024-01-03 00:00:00", 4, 2).collect()] == [2]


def test_absent_review_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id long, platform string")
    assert query.review_by_id(df, 1).count() == 1
    with pytest.raises(LookupError):
        query.review_by_id(df, 2)


def test_trigger_checks():
    ledger.check_trigger(10, 100, "reviews/", "me")
    ledger.check_trigger(None, 100)
    for args in ((0, 100), (101, 100), (5, 100, "  "), (5, 100, None, "x" * 101)):
        with pytest.raises(ValueError):
            ledger.check_trigger(*args)


def test_retry_takes_failed_jobs_only(spark):
    jobs = spark.createDataFrame([("a", "FAILED"), ("b", "COMPLETED")], "processing_id string, status string").withColumns(
        {"provider": F.lit("AGODA"), "s3_prefix": F.lit("reviews/"), "max_files": F.lit(5)})
    new = ledger.retry_job(jobs, "a", "2024-01-01 00:00:00").collect()
    assert [(r.processing_id, r.status, r.triggered_by) for r in new] == [("a-retry", "PENDING", "RETRY_a")]
    with pytest.raises(ValueError):
        ledger.retry_job(jobs, "b", "2024-01-01 00:00:00")
    with pytest.raises(LookupError):
        ledger.retry_job(jobs, "c", "2024-01-01 00:00:00")


def test_job_file_rows_keep_runs_without_files(spark):
    runs = spark.createDataFrame([("r1", "k1", "COMPLETED"), ("r1", "k2", "FAILED"), ("r2", "k3", "PENDING")],
                                 "run_id string, s3_key string, processing_status string")
    rows = {(r.run_id, r["list"], r.s3_key) for r in ledger.job_file_rows(runs).collect()}
    assert rows == {("r1", "processed", "k1"), ("r1", "failed", "k2"), ("r2", None, None)}


def test_file_status_of_one_version(spark):
    ev = _events(spark)
    assert [r.processing_status for r in ledger.file_status(ev, "a").collect()] == ["COMPLETED"]
    assert ledger.file_status(ev, "a", "other").count() == 0


def _retried(spark):
    """One file tracked, started, failed, retried and completed; one that failed last; one null etag."""
    t = "2024-01-0{} 00:00:00"
    rows = [(1, "a", "e", "PENDING", 1, None), (2, "a", "e", "IN_PROGRESS", 2, None), (3, "a", "e", "FAILED", 3, 3),
            (4, "a", "e", "COMPLETED", 4, 4), (5, "b", "e", "COMPLETED", 2, 2), (6, "b", "e", "FAILED", 5, 5), (7, "c", None, "PENDING", 1, None)]
    schema = ("id long, s3_key string, etag string, processing_status string, updated_at string, processing_completed_at string, "
              "provider string, created_at string, file_size long, last_modified_date string, records_processed int")
    df = spark.createDataFrame([(i, k, e, s, t.format(u), c and t.format(c), "Agoda", t.format(1), 9, t.format(1), 4)
                                for i, k, e, s, u, c in rows], schema)
    times = ("updated_at", "processing_completed_at", "created_at", "last_modified_date")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def test_statistics_and_finders_count_files_not_events(spark):
    ev = _retried(spark)
    r = stats.file_statistics(ev).first()
    assert (r.total_files, r.completed_files, r.failed_files, r.pending_files) == (3, 1, 1, 1)
    assert {(x.processing_status, x.file_count) for x in stats.file_counts(ev).collect()} == {
        ("COMPLETED", 1), ("FAILED", 1), ("PENDING", 1)}
    assert [x.s3_key for x in ledger.old_files(ev, "2024-02-01 00:00:00", ["FAILED"]).collect()] == ["b"]
    assert [x.s3_key for x in ledger.files_by_status(ev, "COMPLETED", "Agoda").collect()] == ["a"]
    assert [x.s3_key for x in ledger.recent_files(ev, "Agoda", "2024-01-02 00:00:00", 48).collect()] == ["a"]
    assert stats.files_today(ev, "2024-01-03 12:00:00").first().failed_today == 0
    one = ledger.job_summary(ledger.ledger_runs(ev)).first()
    assert (one.processed_files, one.failed_files, one.total_reviews) == (1, 1, 4)
    lines = spark.createDataFrame([("a", 1), ("b", 1)], "file_key string, line_no int")
    assert [x.file_key for x in ledger.replay_failed(ledger.ledger_runs(ev), lines).collect()] == ["b"]


def test_a_purged_file_leaves_no_older_state(spark, scratch):
    from feedstack.sources import tables as T
    ev = _retried(spark)
    kept = ledger.cleanup_by_created(ev, "2024-06-01 00:00:00")
    assert [(r.s3_key, r.processing_status) for r in kept.collect()] == [("c", "PENDING")]
    kept = ledger.cleanup_by_completed(ev, "2024-01-05 00:00:00")
    assert sorted(r.s3_key for r in kept.collect()) == ["b", "b", "c"]
    root = f"{scratch}/ledger"
    T.write_batch(ev.filter("id < 4"), root, "1")
    T.write_batch(ev.filter("id >= 4"), root, "2")
    assert ledger.purge_ledger(spark, root, "2024-06-01 00:00:00") == 6
    assert [r.s3_key for r in T.read_store(spark, root).collect()] == ["c"]
    assert ledger.purge_ledger(spark, root, "2024-06-01 00:00:00") == 0


def test_tracked_files_fit_the_log(spark):
    ev = _retried(spark)
    files = ev.select("s3_key", "etag", "file_size", "last_modified_date", "provider").distinct().unionByName(
        spark.createDataFrame([("new", "e", 5, "Booking")], "s3_key string, etag string, file_size long, provider string")
        .withColumn("last_modified_date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    new = ledger.track_files(files.filter("etag is not null"), ev, "2024-03-01 00:00:00")
    assert new.columns == ev.columns
    state = {r.s3_key: (r.id, r.processing_status, str(r.created_at)) for r in ledger.current_state(ev.unionByName(new)).collect()}
    assert state["new"] == (8, "PENDING", "2024-03-01 00:00:00") and state["a"][1] == "COMPLETED"


def test_provider_by_exact_name(spark):
    known = spark.createDataFrame([(1, "Agoda", "AGODA"), (2, "Booking", "BOOKING")], "id long, name string, code string")
    names = spark.createDataFrame([("Agoda",), ("agoda",), ("Agoda",), (None,), ("Agod",)], "name string")
    got = {r.name: (r.code, r.name_exists) for r in query.providers_by_name(known, names).collect()}
    assert got == {"Agoda": ("AGODA", True), "agoda": (None, False), None: (None, False), "Agod": (None, False)}


def test_replay_narrows_the_lines_before_their_shuffle(spark):
    runs = spark.createDataFrame([("a", "FAILED"), ("b", "COMPLETED"), (None, "FAILED")], "s3_key string, processing_status string")
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)] + [(f"c{i}", 1) for i in range(500)],
                                  "file_key string, line_no int")
    got = ledger.replay_failed(runs, lines)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 2)]
    assert "bitmap_construct_agg" in got._jdf.queryExecution().optimizedPlan().toString()
