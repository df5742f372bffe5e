"""Partial states beside a store (A1, A2, A26) and heavy groups of N20."""

import os
import random

from pyspark.sql import functions as F

from feedstack.operators import dedup, stats
from feedstack.sources import states as S
from feedstack.sources import tables as T


def _reviews(spark, ids):
    rows = [(i, f"P{i % 3}" if i % 11 else None, i % 7, None if i % 13 == 0 else float(i % 10), f"2024-01-{1 + i % 28:02d} 00:00:00") for i in ids]
    return spark.createDataFrame(rows, "id long, platform string, hotel_id long, rating double, review_date string").withColumn(
        "review_date", F.col("review_date").cast("timestamp_ntz"))


def _same(spark, root):
    store = T.read_store(spark, root)
    want = sorted(map(str, stats.platform_statistics(store).collect()))
    one = stats.review_statistics(store).first()
    assert sorted(map(str, S.platform_statistics(spark, root).drop("median_rating").collect())) == want
    assert S.review_statistics(spark, root).first() == one


def test_merged_states_follow_batches_replays_purges_and_compactions(spark, scratch):
    root = os.path.join(scratch, "reviews")
    assert S.merged(spark, root, S.REVIEWS) is None
    for b in range(3):
        T.write_reviews(_reviews(spark, range(b * 40, b * 40 + 40)), root, f"b{b}")
    assert len(S.write_states(spark, root, S.REVIEWS)) == 3 and S.write_states(spark, root, S.REVIEWS) == []
    _same(spark, root)
    T.write_reviews(_reviews(spark, range(500, 530)), root, "b3")   # no state yet
    _same(spark, root)
    T.write_reviews(_reviews(spark, range(900, 910)), root, "b1")   # replayed: its old state is another folder's
    _same(spark, root)
    S.write_states(spark, root, S.REVIEWS)
    T.compact_reviews(spark, root)
    _same(spark, root)
    assert len(S.write_states(spark, root, S.REVIEWS)) == 1
    T.write_reviews(_reviews(spark, [7, 8]), root, "b0")            # replayed after the compaction
    _same(spark, root)
    T.purge(spark, root, _reviews(spark, [8, 45, 501, 905]), ["id"], ["platform"])
    _same(spark, root)
    S.write_states(spark, root, S.REVIEWS)
    S.vacuum_states(spark, root, S.REVIEWS)
    assert len(S._known(spark, root, S.REVIEWS)) == 1
    _same(spark, root)


def test_merged_percentiles_lie_within_the_stated_error(spark, scratch):
    root, rnd = os.path.join(scratch, "metrics"), random.Random(3)
    rows = [("m", "A" if i % 3 else "B", rnd.expovariate(1 / 300)) for i in range(60_000)]
    df = spark.createDataFrame(rows, "metric string, provider string, value double")
    for b in range(4):
        T.write_batch(df.filter(F.pmod(F.hash("value"), F.lit(4)) == b), root, f"b{b}")
        if b < 3:
            S.write_states(spark, root, S.TIMERS)
    want = {r.provider: r for r in stats.metric_timers(df).collect()}
    for r in S.metric_timers(spark, root).collect():
        values = sorted(v for _, p, v in rows if p == r.provider)
        for q, v in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
            assert abs(sum(x <= v for x in values) / len(values) - q) < 0.002
        w = want[r.provider]
        assert r["count"] == w["count"] and r.max_ms == w.max_ms and abs(r.total_ms - w.total_ms) < 1e-3
        assert (r.le_100ms, r.le_500ms, r.le_1000ms) == (w.le_100ms, w.le_500ms, w.le_1000ms)


def test_a_group_with_a_third_of_all_rows_is_split(spark):
    rows = [(i, 1 if i % 3 == 0 else i % 997, "hot" if i % 3 == 0 else f"h{i % 1993}") for i in range(30_000)]
    rows += [(90_000, None, "x"), (90_001, None, "x"), (90_002, 5, None), (90_003, 5, None), (90_004, 6, "only")]
    df = spark.createDataFrame(rows, "id long, hotel_id long, content_hash string").repartition(6)
    key = ["hotel_id", "content_hash"]
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    want = sorted(r.id for r in df.join(groups, key, "left_semi").collect())
    assert sorted(r.id for r in dedup.potential_duplicates(df).collect()) == want
    assert dedup.potential_duplicates(df).columns == df.columns
    dealt, shares = dedup.salted(df, groups.filter("hotel_id is not null and content_hash is not null"), key)
    per = [r["n"] for r in dealt.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(per) < 2 * len(rows) / (dedup.SHARES * 8)   # the hot group alone has a third of the rows
    assert shares.filter("hotel_id = 1 and content_hash = 'hot'").count() > 8
