"""Ingest many JSON-Lines files into a parquet review store,
with a ledger of files and a per-file result, idempotent per batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ts
from ..operators.ledger import filter_unprocessed
from ..session import discard, staged
from ..sources import keys, tables
from ..sources import providers as P
from ..sources.files import list_files, scan_lines
from . import ingest as E


def ingest_lines(spark: SparkSession, lines: DataFrame, root: str, batch_id: str, as_of: str,
                 files: DataFrame | None = None) -> DataFrame:
    """Tag, write stored reviews / rejects / per-file results for one batch
    under ``root`` and return its ledger events.  Sinks are written to
    ``batch_id=`` directories (overwrite), the ledger last.  ``files``: the
    listing (S2) of the batch, for the size and time of its files.

    A ledger row is a full event: its sequence number ``id`` follows those of
    the batches before it, so of two runs with one ``as_of`` the later one
    counts; a replayed batch keeps the number that it had."""
    if not tables.committed_batches(spark, f"{root}/keys") and tables.read_store(spark, f"{root}/reviews") is not None:
        keys.rebuild_keys(spark, f"{root}/reviews", f"{root}/keys")
    lined = E.stage_lines(lines, as_of)
    known = keys.stored_keys(spark, f"{root}/keys", E.batch_winners(lined), batch_id)
    # The tags (position and outcome) are written once: reviews, keys and results read them, and dedup runs once.
    tags = staged(E.tag_lines(lined.select("file_key", "line_no", "stage", "platform", "hotel_review_id"), store=known)
                  .select("file_key", "line_no", "outcome"), "tags")
    tagged = lined.join(tags, ["file_key", "line_no"])
    tables.write_reviews(E.stored_reviews(tagged), f"{root}/reviews", batch_id)
    keys.write_keys(tagged.filter(F.col("outcome") == "valid"), f"{root}/keys", batch_id)
    tables.write_batch(E.reject_lines(lined), f"{root}/rejects", batch_id)
    tables.write_batch(_new_providers(spark, lined, root, batch_id), f"{root}/providers", batch_id)
    result = E.file_result(tagged)
    first_provider = lined.groupBy("file_key").agg(F.min("provider").alias("provider"))
    result = result.join(first_provider, "file_key", "left")
    if files is not None:
        result = result.join(files.withColumnRenamed("s3_key", "file_key"), "file_key", "left")
    else:
        result = result.withColumns({"file_size": F.lit(None).cast("long"), "last_modified_date": ts(as_of)})
    status = F.when(F.col("successful"), F.lit("COMPLETED")).otherwise(F.lit("FAILED"))
    now = ts(as_of)
    ledger_rows = result.select(
        F.lit(_sequence(spark, root, batch_id)).alias("id"), F.col("file_key").alias("s3_key"),
        F.md5(F.concat_ws("|", F.col("file_size").cast("string"), F.col("last_modified_date").cast("string"))).alias("etag"),
        "file_size", "last_modified_date", "provider", status.alias("processing_status"),
        F.col("valid_count").cast("int").alias("records_processed"),
        F.col("invalid_count").cast("int").alias("records_failed"),
        F.col("duplicate_count").cast("int").alias("records_skipped"),
        F.col("error_summary").alias("error_message"), now.alias("created_at"), now.alias("processing_started_at"),
        now.alias("processing_completed_at"), now.alias("updated_at"))
    tables.write_batch(ledger_rows, f"{root}/ledger", batch_id)
    discard(tags)
    discard(lined)
    return spark.read.parquet(f"{root}/ledger/batch_id={batch_id}")


def _sequence(spark: SparkSession, root: str, batch_id: str) -> int:
    """The sequence number of a batch's events: its own where it was written before, else the one after all others."""
    events = tables.read_store(spark, f"{root}/ledger")
    if events is None:
        return 1
    known = events.agg(F.max(F.when(F.col("batch_id") == batch_id, F.col("id"))).alias("own"), F.max("id").alias("last")).first()
    return known.own or (known.last or 0) + 1


def _new_providers(spark: SparkSession, lined: DataFrame, root: str, batch_id: str) -> DataFrame:
    """The providers that a batch creates, from the names of its valid
    lines; those of other batches and the sample rows are known."""
    known = P.seed_providers(spark)
    prior = tables.read_store(spark, f"{root}/providers")
    if prior is not None:
        known = known.unionByName(P.with_type(prior).filter(F.col("batch_id") != batch_id).select(*known.columns))
    names = lined.filter(F.col("stage") == "candidate").select(F.col("provider_name"))
    return P.created_providers(names, known)


def ingest_files(spark: SparkSession, folder: str, root: str, batch_id: str, as_of: str,
                 only_new: bool = True) -> DataFrame:
    """The JSON-Lines files of a folder (S2) that the ledger does not have
    as COMPLETED (S4), in one plan; a bad file never stops the others.
    ``only_new=False`` takes all of them again.  The names of the files go
    through the driver, as for any read; nothing to do gives no events."""
    files = list_files(spark, folder)
    ledger = tables.read_store(spark, f"{root}/ledger") if only_new else None
    if ledger is not None:
        files = filter_unprocessed(files, ledger.filter(F.col("batch_id") != batch_id))
    paths = [r.s3_key for r in files.select("s3_key").collect()]
    if not paths:
        return spark.createDataFrame([], "id long, s3_key string, processing_status string, records_processed int, "
                                         "records_failed int, records_skipped int, error_message string")
    return ingest_lines(spark, scan_lines(spark, paths), root, batch_id, as_of, files)
