"""File ledger and job operators.

The ledger is append-only: every transition is an event row
``(s3_key, etag, status, ..., event_ts)`` and the current state of a file is
``max_by`` over its events (W2), a partial aggregate.  There is no in-place
update, so reruns and replays are idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..bitmaps import narrowed
from ..functions.dates import shift, ts
from ..functions.rows import duration_ms, job_progress
from ..functions.text import contains_ci, truncate
from ..session import staged
from ..sources import tables
from .dedup import latest_per_key

def current_state(events: DataFrame) -> DataFrame:
    """Latest ledger row per (s3_key, etag) by ``updated_at``, then by the
    sequence number ``id``; an event log without one of these columns is
    ordered by the others.  Every column of the log is kept."""
    key = [c for c in ("s3_key", "etag") if c in events.columns]
    order = [c for c in ("updated_at", "id") if c in events.columns]
    return latest_per_key(events, key, order, [c for c in events.columns if c not in key]).select(*events.columns)


def state_columns(events: DataFrame, *cols: str) -> DataFrame:
    """The current state of every file, with the given columns only: no other column is shuffled."""
    kept = [c for c in events.columns if c in ("s3_key", "etag", "updated_at", "id", *cols)]
    return current_state(events.select(*kept))


def _completed(ledger: DataFrame) -> DataFrame:
    return state_columns(ledger, "processing_status").filter(F.col("processing_status") == "COMPLETED")


def filter_unprocessed(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keys whose current state is not COMPLETED (anti join)."""
    return keys.join(_completed(ledger).select("s3_key"), "s3_key", "left_anti")


def is_processed(keys: DataFrame, ledger: DataFrame, with_etag: bool = False) -> DataFrame:
    """L2: keys (or key+etag) whose current state is COMPLETED (semi join)."""
    on = ["s3_key", "etag"] if with_etag else ["s3_key"]
    return keys.join(_completed(ledger).select(*on), on, "left_semi")


def next_id(events: DataFrame) -> int:
    """The sequence number after all those of an event log."""
    return (events.agg(F.max("id").alias("id")).first().id or 0) + 1


def track_files(files: DataFrame, ledger: DataFrame, as_of: str) -> DataFrame:
    """L3: PENDING events for (key, etag) pairs not yet in the ledger, with all columns of the ledger, so that they can be
    appended to it: created and updated now, no counts yet, and the next sequence number of the log."""
    new = files.join(ledger.select("s3_key", "etag").distinct(), ["s3_key", "etag"], "left_anti")
    now, zero = ts(as_of), F.lit(0)
    given = {c: F.col(c) for c in ("s3_key", "etag", "file_size", "last_modified_date", "provider")} | {
        "processing_status": F.lit("PENDING"), "created_at": now, "updated_at": now,
        "records_processed": zero, "records_failed": zero, "records_skipped": zero}
    if "id" in ledger.columns:
        given["id"] = F.lit(next_id(ledger))
    none = F.lit(None)
    return new.select(*[given.get(f.name, none).cast(f.dataType).alias(f.name) for f in ledger.schema.fields])


def mark(ledger: DataFrame, keys: DataFrame, status: str, as_of: str, error: str | None = None) -> DataFrame:
    """One transition event for each given file, from its current
    state: IN_PROGRESS (started_at, error cleared), COMPLETED (completed_at,
    error cleared, and the record counts where ``keys`` carries them) or
    FAILED (message cut at 2000 chars; no message stays null).  The event's
    sequence number follows the current one.  ``unknown_keys`` tells the keys
    that have no event."""
    now = ts(as_of)
    counts = [c for c in ("records_processed", "records_failed", "records_skipped") if c in keys.columns and status == "COMPLETED"]
    given = keys.groupBy("s3_key").agg(*[F.max(c).alias(f"_{c}") for c in counts]) if counts else keys.select("s3_key").distinct()
    cur = current_state(ledger).join(given, "s3_key")
    cols = {"processing_status": F.lit(status), "updated_at": now}
    if "id" in ledger.columns:
        cols["id"] = F.col("id") + 1
    if status == "IN_PROGRESS":
        cols.update({"processing_started_at": now, "error_message": F.lit(None).cast("string")})
    elif status == "COMPLETED":
        cols.update({"processing_completed_at": now, "error_message": F.lit(None).cast("string"),
                     **{c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in counts}})
    elif status == "FAILED":
        cols.update({"processing_completed_at": now,
                     "error_message": truncate(F.lit(error).cast("string"), K.LEDGER_ERROR_MAX)})
    return cur.withColumns(cols).drop(*[f"_{c}" for c in counts])


def unknown_keys(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of a transition that the ledger does not know."""
    return keys.join(ledger.select("s3_key"), "s3_key", "left_anti")


def file_status(ledger: DataFrame, key: str, etag: str | None = None) -> DataFrame:
    """The current state of one file (of all its versions without an etag)."""
    own = F.col("s3_key") == key
    return current_state(ledger.filter(own if etag is None else own & (F.col("etag") == etag)))


def duplicate_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose key and etag the ledger already has."""
    return files.join(ledger.select("s3_key", "etag"), ["s3_key", "etag"], "left_semi")


def files_by_status(ledger: DataFrame, status: str, provider: str | None = None) -> DataFrame:
    """Files that are in a status now."""
    cond = F.col("processing_status") == status
    if provider is not None:
        cond = cond & (F.col("provider") == provider)
    return current_state(ledger).filter(cond)


def old_files(ledger: DataFrame, cutoff: str, statuses: list[str]) -> DataFrame:
    """Created before cutoff and now in one of the statuses, oldest first."""
    return (current_state(ledger).filter((F.col("created_at") < ts(cutoff)) & F.col("processing_status").isin(*statuses))
            .orderBy("created_at", "id"))


def stuck_files(ledger: DataFrame, as_of: str, hours: int = K.STUCK_AFTER_HOURS) -> DataFrame:
    """Currently IN_PROGRESS and started more than ``hours`` before as_of (Q-8)."""
    return current_state(ledger).filter((F.col("processing_status") == "IN_PROGRESS")
                                        & (F.col("processing_started_at") < shift(ts(as_of), hours=-hours)))


def reset_stuck(ledger: DataFrame, as_of: str) -> DataFrame:
    """FAILED events for stuck files with the timeout message."""
    return stuck_files(ledger, as_of).withColumns({
        "processing_status": F.lit("FAILED"),
        "error_message": F.lit(K.STUCK_MESSAGE),
        "updated_at": ts(as_of)}).withColumns({"id": F.col("id") + 1} if "id" in ledger.columns else {})


def recent_files(ledger: DataFrame, provider: str, as_of: str, hours: int) -> DataFrame:
    """provider's COMPLETED files created in the last ``hours``, newest first."""
    return (current_state(ledger).filter((F.col("provider") == provider) & (F.col("processing_status") == "COMPLETED")
                                         & (F.col("created_at") >= shift(ts(as_of), hours=-hours)))
            .orderBy(F.col("created_at").desc(), "id"))


FILE = ["s3_key", "etag"]


def doomed_by_created(ledger: DataFrame, as_of: str, days: int = K.CLEANUP_AFTER_DAYS) -> DataFrame:
    """Files (key and etag) now in a terminal status and created more than ``days`` ago."""
    old = (F.col("created_at") < shift(ts(as_of), days=-days)) & F.col("processing_status").isin(*K.CLEANUP_STATUSES)
    return state_columns(ledger, "created_at", "processing_status").filter(old).select(*FILE)


def doomed_by_completed(ledger: DataFrame, cutoff: str) -> DataFrame:
    """Files (key and etag) whose current state was completed before cutoff."""
    return (state_columns(ledger, "processing_completed_at").filter(F.col("processing_completed_at") < ts(cutoff))
            .select(*FILE))


def without_files(ledger: DataFrame, doomed: DataFrame) -> DataFrame:
    """The events that remain when files go: a purged file keeps none, so no older state of it comes back."""
    gone = doomed.select(*[F.col(c).alias(f"_{c}") for c in FILE])
    return ledger.join(gone, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FILE], "left_anti")


def cleanup_by_created(ledger: DataFrame, as_of: str, days: int = K.CLEANUP_AFTER_DAYS) -> DataFrame:
    """The events that remain after files in a terminal status created more than ``days`` ago have gone."""
    return without_files(ledger, doomed_by_created(ledger, as_of, days))


def cleanup_by_completed(ledger: DataFrame, cutoff: str) -> DataFrame:
    """The events that remain after files completed before cutoff have gone."""
    return without_files(ledger, doomed_by_completed(ledger, cutoff))


def purge_ledger(spark: SparkSession, root: str, as_of: str, days: int = K.CLEANUP_AFTER_DAYS) -> int:
    """L13 / K4 on a stored ledger: drops every event of the files to go, as a new version; returns how many."""
    events = tables.read_store(spark, root)
    return 0 if events is None else tables.purge(spark, root, doomed_by_created(events, as_of, days), FILE)


def job_status(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs in response shape, with duration (R11) and progress."""
    return jobs.select(
        "processing_id", "status", "provider", "start_time", "end_time", "total_files", "processed_files",
        F.col("failed_files"), "total_reviews", "error_message",
        duration_ms("start_time", "end_time", ts(as_of)).cast("double").alias("duration_ms"),
        F.round(job_progress("processed_files", "failed_files", "total_files"), 6).alias("progress_pct"))


def job_history(jobs: DataFrame, as_of: str, provider: str | None = None, start: str | None = None,
                end: str | None = None, limit: int | None = None) -> DataFrame:
    """Created between start 00:00 and end 23:59:59 (default the last
    30 days), newest first; at most ``limit`` rows where a caller asks."""
    end_ts = ts(f"{end} 23:59:59") if end else ts(as_of)
    start_ts = ts(f"{start} 00:00:00") if start else shift(ts(as_of), days=-K.JOB_HISTORY_DEFAULT_DAYS)
    cond = F.col("created_at").between(start_ts, end_ts)
    if provider is not None:
        cond = cond & (F.col("provider") == provider)
    found = jobs.filter(cond).orderBy(F.col("created_at").desc(), "processing_id")
    return found if limit is None else found.limit(limit)


def jobs_by_status(jobs: DataFrame, statuses: list[str], providers: list[str] | None = None) -> DataFrame:
    """Status in list (and provider in list), newest first."""
    cond = F.col("status").isin(*statuses)
    if providers:
        cond = cond & F.col("provider").isin(*providers)
    return jobs.filter(cond).orderBy(F.col("created_at").desc(), "processing_id")


def jobs_older_than(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Jobs created before cutoff (purging keeps the complement)."""
    return jobs.filter(F.col("created_at") < ts(cutoff))


def retryable_jobs(jobs: DataFrame, status: str = "FAILED") -> DataFrame:
    """status = x and ended."""
    return jobs.filter((F.col("status") == status) & F.col("end_time").isNotNull())


def check_trigger(max_files: int | None, most_files: int, prefix: str | None = None, triggered_by: str | None = None) -> None:
    """The argument checks of a processing request."""
    if max_files is not None and max_files < 1:
        raise ValueError("Max files must be greater than 0")
    if max_files is not None and max_files > most_files:
        raise ValueError(f"Max files cannot exceed {most_files} per request")
    if prefix is not None and not prefix.strip():
        raise ValueError("S3 prefix cannot be empty if specified")
    if triggered_by is not None and len(triggered_by) > 100:
        raise ValueError("Triggered by cannot exceed 100 characters")


def retry_jobs(jobs: DataFrame, as_of: str) -> DataFrame:
    """A new PENDING run for each FAILED job of ``jobs``, over the same
    provider, prefix and number of files."""
    return jobs.filter(F.col("status") == "FAILED").select(
        F.concat("processing_id", F.lit("-retry")).alias("processing_id"), F.lit("PENDING").alias("status"), "provider",
        F.lit(True).alias("is_asynchronous"), "s3_prefix", "max_files",
        F.concat(F.lit("RETRY_"), "processing_id").alias("triggered_by"), ts(as_of).alias("created_at"))


def retry_job(jobs: DataFrame, processing_id: str, as_of: str) -> DataFrame:
    """L20 for one job: an unknown id, or a job that did not fail, is an error."""
    own = jobs.filter(F.col("processing_id") == processing_id)
    found = own.select("status").first()
    if found is None:
        raise LookupError(f"Processing job not found: {processing_id}")
    if found.status != "FAILED":
        raise ValueError(f"Cannot retry job in status: {found.status}")
    return retry_jobs(own, as_of)


def select_job_files(files: DataFrame, ledger: DataFrame, provider: str | None, max_files: int | None = None) -> DataFrame:
    """Keys containing the provider name (case-insensitive), not yet
    processed, oldest first; the first ``max_files`` where a caller asks."""
    cand = files if provider is None else files.filter(contains_ci("s3_key", provider))
    found = filter_unprocessed(cand, ledger).orderBy("last_modified_date", "s3_key")
    return found if max_files is None else found.limit(max_files)


def _iso(col: str) -> Column:
    """A wall-clock time as ISO text: seconds and fraction only where there are any."""
    frac = F.date_format(col, "SSSSSS")
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm"), F.when(
        frac != "000000", F.concat(F.date_format(col, ":ss."), F.regexp_replace(frac, "000\\z", "")))
        .when(F.second(col) != 0, F.date_format(col, ":ss")).otherwise(F.lit("")))


def job_log_lines(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered text lines per job: created, started, files done and
    failed (where there are any), ended, error; the first ``limit`` of them
    where a caller asks."""
    done, failed = F.col("processed_files"), F.col("failed_files")
    lines = F.filter(F.array(
        F.format_string("[%s] Processing job created: %s", _iso("created_at"), F.col("processing_id")),
        F.when(F.col("start_time").isNotNull(), F.format_string("[%s] Processing started", _iso("start_time"))),
        F.when(done > 0, F.format_string("Processed %d files successfully", done)),
        F.when(failed > 0, F.format_string("Failed to process %d files", failed)),
        F.when(F.col("end_time").isNotNull(), F.format_string(
            "[%s] Processing completed with status: %s", _iso("end_time"), F.col("status"))),
        F.when(F.col("error_message").isNotNull(), F.concat(F.lit("Error: "), F.col("error_message")))),
        lambda x: x.isNotNull())
    out = jobs.select("processing_id", F.posexplode(lines).alias("log_pos", "log_line"))
    return out if not limit or limit < 0 else out.filter(F.col("log_pos") < limit)


def job_events(jobs: DataFrame) -> DataFrame:
    """The event log of each job row: created (PENDING), started
    (IN_PROGRESS) and ended (final status), with a sequence number that
    orders events sharing a timestamp."""
    created = jobs.select("processing_id", F.col("created_at").alias("event_ts"), F.lit(0).alias("seq"),
                          F.lit("PENDING").alias("status"))
    started = jobs.filter(F.col("start_time").isNotNull()).select(
        "processing_id", F.col("start_time").alias("event_ts"), F.lit(1).alias("seq"), F.lit("IN_PROGRESS").alias("status"))
    ended = jobs.filter(F.col("end_time").isNotNull()).select(
        "processing_id", F.col("end_time").alias("event_ts"), F.lit(2).alias("seq"), "status")
    return created.unionByName(started).unionByName(ended)


def ledger_runs(ledger: DataFrame) -> DataFrame:
    """Processing runs derived from the ledger: one run per provider and
    creation day (``run_id``), with the current state of its files as the child table."""
    return current_state(ledger).withColumn("run_id", F.concat(F.col("provider"), F.lit("-"),
                                                F.date_format("created_at", "yyyy-MM-dd")))


def job_files_join(runs: DataFrame) -> DataFrame:
    """Run -> processed / failed file names (one-to-many), summarised per
    run with counts and first/last names (bounded per run, no list collect)."""
    st = F.col("processing_status")
    return runs.groupBy("run_id").agg(
        F.count_if(st == "COMPLETED").alias("processed_file_count"),
        F.count_if(st == "FAILED").alias("failed_file_count"),
        F.min(F.when(st == "COMPLETED", F.col("s3_key"))).alias("first_processed_file"),
        F.max(F.when(st == "FAILED", F.col("s3_key"))).alias("last_failed_file"))


def job_file_rows(runs: DataFrame) -> DataFrame:
    """The file rows of every run: (run_id, list, s3_key) with the list
    ``processed`` or ``failed``; a run with neither has one row of nulls.
    Only run ids are compared, so a run of any size is never gathered."""
    st = F.col("processing_status")
    kind = F.when(st == "COMPLETED", F.lit("processed")).when(st == "FAILED", F.lit("failed"))
    files = runs.select("run_id", kind.alias("list"), "s3_key").filter(F.col("list").isNotNull())
    bare = runs.groupBy("run_id").agg(F.count(kind).alias("_n")).filter(F.col("_n") == 0)
    none = F.lit(None).cast("string")
    return files.unionByName(bare.select("run_id", none.alias("list"), none.alias("s3_key")))


def job_summary(runs: DataFrame) -> DataFrame:
    """One row for each run: files done and failed, reviews stored, and
    the summary line.  A failed file never stops the others."""
    st = F.col("processing_status")
    one = runs.groupBy("run_id").agg(
        F.count_if(st == "COMPLETED").alias("processed_files"), F.count_if(st == "FAILED").alias("failed_files"),
        F.coalesce(F.sum(F.when(st == "COMPLETED", F.col("records_processed"))), F.lit(0)).cast("long").alias("total_reviews"))
    return one.withColumn("summary", F.format_string(
        "Processing completed for job: %s. Files processed: %d, Failed: %d, Total reviews: %d",
        "run_id", "processed_files", "failed_files", "total_reviews"))


def replay_failed(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of the failed files of runs, ready for a new ingest run
    (semi join on the file key; no per-file loop).  The names of the failed
    files are written once; a bitmap of them keeps most lines of other files
    out of the shuffle."""
    failed_files = staged(runs.filter(F.col("processing_status") == "FAILED").select(F.col("s3_key").alias("file_key")), "failed")
    likely = narrowed(lines, ["file_key"], failed_files, ["file_key"], failed_files.count())
    return likely.join(failed_files, "file_key", "left_semi")
