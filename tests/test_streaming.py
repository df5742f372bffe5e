import os

import pytest
from pyspark.sql import functions as F

from feedstack.sources import tables as T
from feedstack.streaming.ingest import batch_clock, read_counters, stream_counters, stream_ingest
from helpers import AS_OF, line


def test_stream_ingest_once_and_dedup(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jl"), "w") as fh:
        fh.write(line(hotelReviewId=1) + "\n" + line(hotelReviewId=2) + "\n\n")
    root, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    stream_ingest(spark, src, root, ckpt, AS_OF).awaitTermination()
    # a new file repeating one review and adding one
    with open(os.path.join(src, "b.jl"), "w") as fh:
        fh.write(line(hotelReviewId=2) + "\n" + line(hotelReviewId=3) + "\n")
    stream_ingest(spark, src, root, ckpt, AS_OF).awaitTermination()
    # rerun with nothing new: no new batch
    stream_ingest(spark, src, root, ckpt, AS_OF).awaitTermination()
    reviews = spark.read.parquet(os.path.join(root, "reviews"))
    assert sorted(r.hotel_review_id for r in reviews.collect()) == ["1", "2", "3"]
    ledger = spark.read.parquet(os.path.join(root, "ledger"))
    assert ledger.count() == 2
    counters = os.path.join(scratch, "counters")
    stream_counters(spark, os.path.join(root, "ledger"), counters, os.path.join(scratch, "ckpt2")).awaitTermination()
    rows = {(r.provider, r.processing_status): (r.files, r.reviews) for r in read_counters(spark, counters).collect()}
    assert rows == {("Agoda", "COMPLETED"): (2, 3)}


def _event(spark, root, batch, rows):
    df = spark.createDataFrame(rows, "id long, s3_key string, provider string, processing_status string, records_processed int, "
                                     "updated_at string")
    df = df.withColumns({"updated_at": F.col("updated_at").cast("timestamp_ntz"), "etag": F.lit("e")})
    T.write_batch(df, os.path.join(root, "ledger"), batch)


def test_counters_move_files_between_statuses_and_survive_a_crash(spark, scratch, monkeypatch):
    root, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    ledger_dir, counters = os.path.join(root, "ledger"), os.path.join(scratch, "counters")

    def run():
        q = stream_counters(spark, ledger_dir, counters, ckpt)
        q.awaitTermination()
        return {(r.provider, r.processing_status): (r.files, r.reviews) for r in read_counters(spark, counters).collect()}

    day = "2024-01-0{} 00:00:00"
    _event(spark, root, "1", [(1, "a", "Agoda", "PENDING", 0, day.format(1)), (2, "b", "Agoda", "PENDING", 0, day.format(1)),
                              (3, "c", None, "FAILED", None, day.format(1))])
    assert run() == {("Agoda", "PENDING"): (2, 0), (None, "FAILED"): (1, 0)}
    _event(spark, root, "2", [(4, "a", "Agoda", "IN_PROGRESS", 0, day.format(2)), (5, "a", "Agoda", "COMPLETED", 7, day.format(3))])
    write = T.write_batch

    def fails_after(*args):
        write(*args)
        raise OSError("lost after the write, before the commit of the epoch")

    monkeypatch.setattr(T, "write_batch", fails_after)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    monkeypatch.undo()
    after = {("Agoda", "PENDING"): (1, 0), ("Agoda", "COMPLETED"): (1, 7), (None, "FAILED"): (1, 0)}
    assert run() == after  # the epoch ran twice and counts once
    _event(spark, root, "3", [(6, "a", "Agoda", "FAILED", 0, day.format(2)), (7, "b", "Agoda", "COMPLETED", 2, day.format(5))])
    assert run() == {("Agoda", "COMPLETED"): (2, 9), (None, "FAILED"): (1, 0)}  # the late event of a changes nothing
    assert run() == {("Agoda", "COMPLETED"): (2, 9), (None, "FAILED"): (1, 0)}


def test_every_batch_has_a_clock_and_a_replay_keeps_it(spark, scratch):
    src, root = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(src)
    with open(os.path.join(src, "a.jl"), "w") as fh:
        fh.write(line(hotelReviewId=1, reviewDate="2025-04-10") + "\n")
    stream_ingest(spark, src, root, os.path.join(scratch, "ckpt")).awaitTermination()
    first = spark.read.parquet(os.path.join(root, "clock")).collect()
    assert [r.batch_id for r in first] == ["e00000000"]
    assert batch_clock(spark, root, "e00000000") == first[0].as_of
    # The same batch again (its checkpoint is lost) writes the same rows by the same clock.
    stream_ingest(spark, src, root, os.path.join(scratch, "ckpt-new")).awaitTermination()
    reviews = spark.read.parquet(os.path.join(root, "reviews")).collect()
    assert [(r.hotel_review_id, str(r.created_at)) for r in reviews] == [("1", first[0].as_of)]
