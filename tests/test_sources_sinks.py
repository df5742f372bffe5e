import os

import pytest
from pyspark.sql import functions as F

from feedstack.operators import query
from feedstack.sources import files as S
from feedstack.sources import providers as P
from feedstack.sources import tables as T


def test_listing_and_metadata(spark, scratch):
    for name, body in [("a.jl", "x\n"), ("b.JSONL", "y\n"), ("c.txt", "z\n"), ("empty.jl", "")]:
        with open(os.path.join(scratch, name), "w") as fh:
            fh.write(body)
    files = S.list_files(spark, scratch)
    names = sorted(os.path.basename(r.s3_key) for r in files.collect())
    assert names == ["a.jl", "b.JSONL"]
    key = [r.s3_key for r in files.collect() if r.s3_key.endswith("a.jl")][0]
    assert S.file_metadata(files, key).count() == 1
    with pytest.raises(ValueError):
        S.file_metadata(files, " ")
    keys = spark.createDataFrame([(key,), ("missing.jl",)], "s3_key string")
    assert [r.s3_key for r in S.files_exist(files, keys).collect()] == [key]
    assert S.total_file_size(files).collect()[0].file_count == 2


def test_batch_directories_replace_on_replay(spark, scratch):
    root = os.path.join(scratch, "store")
    T.write_batch(spark.range(3), root, "1")
    T.write_batch(spark.range(5), root, "2")
    T.write_batch(spark.range(2), root, "1")   # replay of batch 1
    assert T.read_store(spark, root).count() == 7
    assert T.read_store(spark, os.path.join(scratch, "nothing")) is None


def test_filters_reach_the_stored_files(spark, scratch):
    root = os.path.join(scratch, "reviews")
    rows = [("AGODA", i, float(i % 11), f"h{i % 3}") for i in range(100)] + [("EXPEDIA", i, 9.0, "x") for i in range(10)]
    df = spark.createDataFrame(rows, "platform string, hotel_id long, rating double, hotel_name string")
    T.write_reviews(df.withColumn("review_date", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), root, "b1")
    found = query.apply_filters(T.read_store(spark, root), query.ReviewFilter(platform="agoda", hotel_id=7, min_rating=5.0))
    plan = found.select("hotel_id", "rating")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "platform" in scan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    pushed = scan.split("PushedFilters:")[1].split("ReadSchema:")[0]
    assert "EqualTo(hotel_id,7)" in pushed and "GreaterThanOrEqual(rating,5.0)" in pushed
    assert "hotel_name" not in scan.split("ReadSchema:")[1].split("\n")[0]
    assert found.count() == 1


def test_unknown_names_become_providers(spark):
    names = spark.createDataFrame([("Agoda",), ("Airbnb",), ("Airbnb",), (None,)], "provider_name string")
    rows = {r.name: r for r in P.lookup_or_create(spark, names).collect()}
    assert sorted(rows) == ["Agoda", "Airbnb", "Booking", "Expedia"]
    made = rows["Airbnb"]
    assert (made.code, made.is_active, made.rating_scale, made.supported_languages, made.external_id) == \
        ("AIRBNB", True, 5.0, "en", None)


def test_providers_have_a_type(spark):
    names = spark.createDataFrame([("Airbnb",)], "provider_name string")
    rows = {r.name: r for r in P.lookup_or_create(spark, names).collect()}
    assert {r.provider_type for r in rows.values()} == {"HOTEL_BOOKING"}
    assert [(n, rows[n].external_id) for n in ("Agoda", "Booking", "Expedia")] == [("Agoda", "332"), ("Booking", "333"), ("Expedia", "334")]
    old = spark.createDataFrame([("x", None), ("y", "FLIGHT")], "name string, provider_type string")
    assert [r.provider_type for r in P.with_type(old).orderBy("name").collect()] == ["HOTEL_BOOKING", "FLIGHT"]
    assert P.with_type(old.drop("provider_type")).filter("provider_type = 'HOTEL_BOOKING'").count() == 2


def test_only_a_small_dimension_is_broadcast(spark):
    dim = spark.range(20).select(F.col("id").cast("string").alias("code"))
    facts = spark.range(100).select((F.col("id") % 20).cast("string").alias("code"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [facts.join(P.sized(dim, most), "code")._jdf.queryExecution().executedPlan().toString() for most in (20, 19)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_active_providers_by_name(spark):
    p = spark.createDataFrame([("b", True), ("a", True), ("c", None)], "name string, is_active boolean")
    assert [r.name for r in P.providers_active(p).collect()] == ["a", "b"]
    assert [r.name for r in P.providers_active(P.set_active(p, "c", True)).collect()] == ["a", "b", "c"]
    assert [r.name for r in P.providers_active(P.set_active(p, "b", False), False).collect()] == ["b", "c"]
