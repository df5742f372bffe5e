"""P1 far down: pages equal a plain sort, also where one date holds most rows, and nothing large is sorted."""

from pyspark.sql import functions as F

from feedstack.operators import query


def _reviews(spark, n):
    day = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(100)).otherwise(F.col("id") % 977)
    return spark.range(n, numPartitions=5).withColumn(
        "review_date", F.timestamp_add("DAY", day, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")))


def test_pages_equal_a_plain_sort(spark):
    df, size = _reviews(spark, 30_000), 40
    rows = [r.id for r in df.orderBy(F.col("review_date").desc_nulls_first(), "id").collect()]
    for no in (0, 1, 249, 250, 400, 700, 749, 750, 2000):
        assert [r.id for r in query.page_deep(df, no, size, rows=500).collect()] == rows[no * size:(no + 1) * size], no
    assert [r.id for r in query.page_deep(df, 5, size).collect()] == rows[200:240]
    assert query.page_deep(df.limit(0), 0, size).count() == 0


def test_only_the_part_with_the_page_is_sorted(spark):
    df = _reviews(spark, 200_000)
    parts = query._located(df.withColumns({"_at": F.coalesce(-F.unix_micros(F.col("review_date").cast("timestamp")), F.lit(-(1 << 63))),
                                           "_tie": F.col("id")}), ["_at", "_tie"], 50_000, 20, 1000)
    assert sum(p.count() for p in parts) == 20
    for p in parts:
        skipped = p._jdf.queryExecution().optimizedPlan().toString()
        assert all(int(x.split()[0]) <= 1000 for x in skipped.split("LocalLimit ")[1:])
