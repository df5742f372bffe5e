"""Rows narrowed by a bitmap of keys before a shuffle: no wanted row is lost, few others stay."""

import pytest
from pyspark.sql import functions as F

from feedstack import bitmaps
from feedstack.operators import dedup


@pytest.mark.parametrize("most", [4096, 1])
def test_narrowed_keeps_every_wanted_row_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(bitmaps, "MOST_ROWS", most)
    df = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("v"))
    wanted = df.filter("k is null or k % 12 = 5").select(F.col("k").alias("w"))
    got = bitmaps.narrowed(df, ["k"], wanted, ["w"], wanted.count())
    assert got.columns == df.columns
    assert got.join(wanted, F.col("k").eqNullSafe(F.col("w")), "left_semi").count() == wanted.count() == 5001
    assert got.count() < (9_000 if most > 1 else 14_000)
    assert bitmaps.narrowed(df, ["k"], wanted.limit(0), ["w"], 0).count() == 0


def test_duplicates_shuffle_only_keys_whose_hash_comes_twice(spark, monkeypatch):
    written = {}
    plain = dedup.staged
    monkeypatch.setattr(dedup, "staged", lambda df, name, *a: written.setdefault(name, plain(df, name, *a)))
    rows = [(i, i % 50, f"h{i}") for i in range(5_000)] + [(9_001, 1, "h1"), (9_002, 1, "h1"), (9_003, None, "h1"), (9_004, None, "h1"),
                                                          (9_005, 2, None), (9_006, 2, None), (9_007, 2, "h1")]
    df = spark.createDataFrame(rows, "id long, hotel_id long, content_hash string")
    assert sorted(r.id for r in dedup.potential_duplicates(df).collect()) == [1, 9_001, 9_002]
    assert 3 <= written["likely"].count() < 500 and written["groups"].count() == 1
