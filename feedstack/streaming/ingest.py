"""ST1-ST3: continuous ingestion of newly arriving JSON-Lines files.

The file source's own checkpoint records which files were taken, so every
file is processed once; each micro-batch runs the batch ingest plan in
``foreachBatch`` and writes to ``batch_id=<epoch>`` directories, so a
replayed epoch overwrites its own output (exactly-once results).  Review
duplicates across runs are removed by an anti join against the stored
keys (no unbounded streaming state).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..plans.files import ingest_lines
from ..sources import tables
from ..sources.files import number_lines, stream_lines


def batch_clock(spark: SparkSession, root: str, batch_id: str) -> str:
    """The time (UTC) at which a batch first ran, written down before anything
    else of it, so that a replay of the batch judges dates by the same clock."""
    path = f"{root.rstrip('/')}/clock"
    known = tables.read_store(spark, path)
    found = None if known is None else known.filter(F.col("batch_id") == batch_id).first()
    if found is not None:
        return found.as_of
    now = dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
    tables.write_batch(spark.range(1).select(F.lit(now).alias("as_of")), path, batch_id)
    return now


def stream_ingest(spark: SparkSession, source_dir: str, root: str, checkpoint: str, as_of: str | None = None,
                  max_files_per_trigger: int = 100, available_now: bool = True,
                  processing_time: str = "10 seconds") -> StreamingQuery:
    """ST1 + ST2.  ``available_now`` drains what is there and stops (a
    scheduled run); otherwise it polls every ``processing_time``.  Every batch
    has its own clock; ``as_of`` fixes one for all (for past data)."""
    lines = stream_lines(spark, source_dir, max_files_per_trigger)

    def run(batch: DataFrame, epoch: int) -> None:
        batch_id = f"e{epoch:08d}"
        ingest_lines(spark, number_lines(batch), root, batch_id, as_of or batch_clock(spark, root, batch_id))

    w = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


#: Columns of a ledger event that the counters read.
EVENT_SCHEMA = ("id long, s3_key string, etag string, provider string, processing_status string, records_processed int, "
                "updated_at timestamp_ntz")
_MOVE_SCHEMA = "provider string, processing_status string, files long, reviews long"


def _moves(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the new events of one file change: -1 file in the status that it leaves, +1 in the one that it is in now."""
    last = state.get if state.exists else None
    best = last
    for rows in batches:
        for r in rows.itertuples(index=False):
            at = (pd.Timestamp(r.updated_at).value if pd.notna(r.updated_at) else -1, int(r.id) if pd.notna(r.id) else -1)
            if best is None or at > tuple(best[:2]):
                done = int(r.records_processed) if pd.notna(r.records_processed) else 0
                best = (*at, r.provider if pd.notna(r.provider) else None,
                        r.processing_status if pd.notna(r.processing_status) else None, done)
    if best is not None and best != last:
        state.update(best)
        moves = [(best[2], best[3], 1, best[4])] + ([(last[2], last[3], -1, -last[4])] if last is not None else [])
        yield pd.DataFrame(moves, columns=["provider", "processing_status", "files", "reviews"])


def stream_counters(spark: SparkSession, ledger_dir: str, root: str, checkpoint: str,
                    available_now: bool = True, processing_time: str = "10 seconds") -> StreamingQuery:
    """ST3: running counters of files and reviews by provider and current status.

    The state of a file is the last event seen of it (one small row a file).  Its new events turn into moves from one status
    to another; the moves of a micro-batch are summed and written as the batch ``e<epoch>`` of the store ``root``,
    one row for each provider and status that changed.  A batch that is replayed after a crash replaces its own rows, so
    every move counts once.  ``read_counters`` sums the batches.  An event that comes late, but is older than the state,
    changes nothing."""
    events = spark.readStream.schema(EVENT_SCHEMA).option("basePath", ledger_dir).parquet(f"{ledger_dir}/batch_id=*")
    moves = (events.select("id", F.coalesce("s3_key", F.lit("")).alias("s3_key"), F.coalesce("etag", F.lit("")).alias("etag"),
                           "provider", "processing_status", "records_processed", "updated_at")
             .groupBy("s3_key", "etag").applyInPandasWithState(
                 _moves, _MOVE_SCHEMA, "at long, id long, provider string, status string, reviews long", "update",
                 "NoTimeout"))

    def merge(batch: DataFrame, epoch: int) -> None:
        changed = (batch.groupBy("provider", "processing_status")
                   .agg(F.sum("files").alias("files"), F.sum("reviews").alias("reviews")))
        tables.write_batch(changed.withColumn("version", F.lit(epoch).cast("long")), root, f"e{epoch:08d}")

    w = moves.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)).start()


def read_counters(spark: SparkSession, root: str) -> DataFrame | None:
    """ST3: files and reviews by provider and status as of the last batch, with its number as ``version``; statuses that no
    file is in any more are left out.  None before the first batch."""
    moves = tables.read_store(spark, root)
    if moves is None:
        return None
    return (moves.groupBy("provider", "processing_status")
            .agg(F.sum("files").alias("files"), F.sum("reviews").alias("reviews"), F.max("version").alias("version"))
            .filter("files <> 0"))


__all__ = ["stream_ingest", "stream_counters", "read_counters"]
