"""Stores with versions (K1, K4) and the key table (X3, ST2)."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from feedstack.plans import files as PF
from feedstack.sources import keys as KT
from feedstack.sources import tables as T
from helpers import AS_OF, line


def _ids(spark, root):
    return sorted(r.id for r in T.read_store(spark, root).collect())


def _rows(spark, ids, **more):
    return spark.createDataFrame([(i, f"f{i}", None if i % 2 else "e") for i in ids], "id long, s3_key string, etag string")


def test_purge_drops_every_row_of_a_key_and_readers_follow_the_version(spark, scratch):
    root = os.path.join(scratch, "t")
    T.write_batch(_rows(spark, [1, 2, 3]), root, "a")
    T.write_batch(_rows(spark, [1, 2, 4]), root, "b")
    before = T.read_store(spark, root)
    assert T.purge(spark, root, _rows(spark, [1, 4, 9]), ["s3_key", "etag"]) == 3
    assert _ids(spark, root) == [2, 2, 3]
    assert sorted(r.id for r in before.collect()) == [1, 1, 2, 2, 3, 4]  # a reader that began before the swap
    assert T.last_version(spark, root)["version"] == 1
    assert T.purge(spark, root, _rows(spark, [9]), ["s3_key", "etag"]) == 0
    assert T.last_version(spark, root)["version"] == 1
    T.vacuum(spark, root)
    assert _ids(spark, root) == [2, 2, 3] and not glob.glob(f"{root}/batch_id=*")


def test_batches_written_beside_and_after_a_purge_count(spark, scratch, monkeypatch):
    root = os.path.join(scratch, "t")
    T.write_batch(_rows(spark, [1, 2]), root, "a")
    T.write_batch(_rows(spark, [3]), root, "b")
    commit = T._commit

    def late(*args):
        T.write_batch(_rows(spark, [7]), root, "c")       # while the purge runs: a new batch
        T.write_batch(_rows(spark, [2, 8]), root, "a")    # and a replay of one that it read
        commit(*args)

    monkeypatch.setattr(T, "_commit", late)
    assert T.purge(spark, root, _rows(spark, [1]), ["s3_key", "etag"]) == 1
    assert _ids(spark, root) == [2, 3, 7, 8]
    monkeypatch.undo()
    T.write_batch(_rows(spark, [30]), root, "b")
    assert _ids(spark, root) == [2, 7, 8, 30]
    assert T.purge(spark, root, _rows(spark, [30]), ["s3_key", "etag"]) == 1 and _ids(spark, root) == [2, 7, 8]
    T.vacuum(spark, root)
    T.write_batch(_rows(spark, [2]), root, "a")
    assert _ids(spark, root) == [2, 7]


def test_two_writers_of_one_version(spark, scratch):
    root = os.path.join(scratch, "t")
    T.write_batch(_rows(spark, [1]), root, "a")
    T._commit(spark, root, {"version": 1, "snapshot": None, "inside": {}})
    with pytest.raises(RuntimeError):
        T._commit(spark, root, {"version": 1, "snapshot": None, "inside": {}})
    assert _ids(spark, root) == [1] and T.purge(spark, os.path.join(scratch, "none"), _rows(spark, [1]), ["id"]) == 0


def test_compaction_merges_files_and_a_replay_replaces_only_itself(spark, scratch):
    root = os.path.join(scratch, "reviews")

    def batch(b, n):
        rows = [(f"P{i % 2}", i, f"{b}-{i}") for i in range(n)]
        df = spark.createDataFrame(rows, "platform string, hotel_id long, hotel_review_id string").repartition(4)
        T.write_reviews(df.withColumn("review_date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), root, b)

    for b in range(6):
        batch(f"b{b}", 20)
    before = sorted(map(tuple, T.read_store(spark, root).select("platform", "hotel_review_id", "batch_id").collect()))
    assert T.compact_reviews(spark, root) == 1 and T.compact_reviews(spark, root) == 1
    after = T.read_store(spark, root)
    assert sorted(map(tuple, after.select("platform", "hotel_review_id", "batch_id").collect())) == before
    assert len(after.inputFiles()) == 2
    plan = after.filter("platform = 'P1' and hotel_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hotel_id,7)" in plan and "platform" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    batch("b2", 5)
    again = T.read_store(spark, root).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in again} == {f"b{b}": 5 if b == 2 else 20 for b in range(6)}


def test_key_table_equals_the_whole_store_join_over_batches_and_a_replay(spark, scratch):
    root, expected = os.path.join(scratch, "out"), {}
    batches = [("b1", [1, 2, 2, 3]), ("b2", [3, 4, 1]), ("b3", [4, 5, 6]), ("b2", [3, 4, 1])]
    for batch, ids in batches:
        lines = spark.createDataFrame([(f"{batch}.jl", i + 1, line(hotelReviewId=x)) for i, x in enumerate(ids)],
                                      "file_key string, line_no int, line string")
        store = T.read_store(spark, f"{root}/reviews")
        known = set() if store is None else {r.hotel_review_id for r in store.filter(F.col("batch_id") != batch).collect()}
        expected[batch] = sorted({str(x) for x in ids} - known)
        PF.ingest_lines(spark, lines, root, batch, AS_OF)
        for name in ("reviews", "keys"):
            got = T.read_store(spark, f"{root}/{name}").filter(F.col("batch_id") == batch).collect()
            assert sorted(r.hotel_review_id for r in got) == expected[batch]
    assert sorted(r.hotel_review_id for r in T.read_store(spark, f"{root}/reviews").collect()) == list("123456")
    # a store without a key table gets one
    new = spark.createDataFrame([("AGODA", "3"), ("AGODA", "99"), (None, "3")], "platform string, hotel_review_id string")
    KT.rebuild_keys(spark, f"{root}/reviews", f"{root}/rebuilt")
    platform = T.read_store(spark, f"{root}/reviews").first().platform
    new = new.withColumn("platform", F.when(F.col("platform").isNotNull(), F.lit(platform)))
    for table in ("keys", "rebuilt"):
        assert [r.hotel_review_id for r in KT.stored_keys(spark, f"{root}/{table}", new).collect()] == ["3"]
    assert not [n for n in os.listdir(spark.conf.get("spark.checkpoint.dir")) if n.startswith("feedstack-tags")]


def test_folders_without_a_new_key_are_not_read(spark, scratch):
    root = os.path.join(scratch, "keys")
    many = spark.range(20_000).select(F.lit("AGODA").alias("platform"), F.col("id").cast("string").alias("hotel_review_id"))
    KT.write_keys(many, root, "b1")
    T.compact(spark, root, ["bucket"], ["key_hash"])
    KT.write_keys(many.withColumn("platform", F.lit("BOOKING")), root, "b2")
    new = many.filter("hotel_review_id in ('17', '4711', 'x')")
    found = KT.stored_keys(spark, root, new)
    assert sorted(r.hotel_review_id for r in found.collect()) == ["17", "4711"]
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.toString().count("dynamicpruning") >= 2
    folders = new.transform(KT.with_bucket).select("bucket").distinct().count()
    read = [int(x) for x in re.findall(r"number of partitions read: ([\d,]+)", _metrics(found))]
    assert read and max(read) <= folders


def _metrics(df):
    """The metrics of the scans of an executed plan."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("ReusedExchange"):
            todo.append(node.child())
        if name.startswith("Scan"):
            metric = node.metrics().get("numPartitions")
            if metric.isDefined():
                out.append(f"number of partitions read: {metric.get().value()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return "\n".join(out)
