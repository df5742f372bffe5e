import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert set(df.columns) >= {"platform", "review_count", "average_rating"}
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
