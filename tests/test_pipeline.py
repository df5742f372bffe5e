import os

from pyspark.sql import functions as F

from feedstack.operators import ledger
from feedstack.operators.parse import parse_lines
from feedstack.plans import ingest as E
from feedstack.plans.files import ingest_files
from feedstack.sources.files import list_files, scan_lines
from helpers import AS_OF, line, lines_df


def _outcomes(tagged):
    return {r.outcome: r["count"] for r in tagged.groupBy("outcome").count().collect()}


def test_three_valid_two_providers(spark):
    lines = [line(hotelReviewId=1), line(platform="Booking", hotelReviewId=2), line(hotelReviewId=3)]
    t = E.ingest_batch(lines_df(spark, lines), AS_OF)
    assert _outcomes(t) == {"valid": 3}
    res = E.batch_result(t).collect()[0]
    assert res.status == "COMPLETED" and res.valid_count == 3
    assert E.stored_reviews(t).select("platform").distinct().count() == 2


def test_mixed_batch_fails(spark):
    lines = [line(hotel_id=-1, hotelReviewId=1), line(platform="InvalidPlatform", hotelReviewId=2),
             line(hotelReviewId=3), line(hotelReviewId=4)]
    res = E.batch_result(E.ingest_batch(lines_df(spark, lines), AS_OF)).collect()[0]
    assert (res.status, res.processed_count, res.valid_count, res.invalid_count, res.error_count) == \
        ("FAILED", 4, 2, 2, 2)


def test_missing_review_id_is_a_processing_failure(spark):
    t = E.ingest_batch(lines_df(spark, [line(hotelReviewId=None)]), AS_OF)
    r = E.reject_lines(t).collect()[0]
    assert r.error.startswith("Line 1: Processing failed - Failed to transform review data")


def test_first_wins_and_invariant(spark):
    lines = [line(hotelReviewId=7), "", "{bad", line(hotelReviewId=7), line(hotelReviewId=8)]
    t = E.ingest_batch(lines_df(spark, lines), AS_OF)
    out = {r.line_no: r.outcome for r in t.select("line_no", "outcome").collect()}
    assert out == {1: "valid", 2: "blank", 3: "malformed", 4: "duplicate", 5: "valid"}


def test_bad_lines_do_not_cost_the_good_ones(spark):
    lines = [line(hotel_id=-1, hotelReviewId=i) for i in range(51)] + [line(hotelReviewId=100 + i) for i in range(10000)]
    t = E.ingest_batch(lines_df(spark, lines), AS_OF)
    assert _outcomes(t) == {"invalid": 51, "valid": 10000}
    assert E.batch_result(t).collect()[0].status == "FAILED"


def test_scan_lines_numbers_across_splits(spark, scratch):
    path = os.path.join(scratch, "big.jl")
    with open(path, "w") as fh:
        for i in range(20000):
            fh.write(f'{{"n": {i}, "pad": "{"x" * (i % 50)}"}}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        df = scan_lines(spark, path)
        assert df.count() == 20000
        bad = df.filter(F.get_json_object("line", "$.n").cast("int") + 1 != F.col("line_no")).count()
        assert bad == 0
        assert spark.read.text(path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rerun_adds_nothing(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.jl"), "w") as fh:
        fh.write(line(hotelReviewId=1) + "\n" + line(hotelReviewId=2) + "\n")
    root = os.path.join(scratch, "out")
    files = list_files(spark, src)
    assert files.count() == 1
    first = ingest_files(spark, src, root, "b1", AS_OF).collect()[0]
    assert ingest_files(spark, src, root, "b2", AS_OF).count() == 0      # the file is done
    second = ingest_files(spark, src, root, "b2", AS_OF, only_new=False).collect()[0]
    assert (first.records_processed, second.records_processed, second.records_skipped) == (2, 0, 2)
    assert spark.read.parquet(os.path.join(root, "reviews")).count() == 2
    # replaying a batch id overwrites its own output
    ingest_files(spark, src, root, "b1", AS_OF)
    assert spark.read.parquet(os.path.join(root, "reviews")).count() == 2


def test_a_file_added_later_is_taken(spark, scratch):
    src, root = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    os.makedirs(src)

    def put(name, i):
        with open(os.path.join(src, name), "w") as fh:
            fh.write(line(hotelReviewId=i) + "\n")

    put("a.jl", 1)
    put("notes.txt", 5)
    ingest_files(spark, src, root, "b1", AS_OF)
    put("b.JSONL", 2)
    events = ingest_files(spark, src, root, "b2", AS_OF).collect()
    assert [(r.s3_key.rpartition("/")[2], r.processing_status) for r in events] == [("b.JSONL", "COMPLETED")]
    assert spark.read.parquet(os.path.join(root, "reviews")).count() == 2
    ingest_files(spark, src, root, "b3", AS_OF, only_new=False)
    state = ledger.current_state(spark.read.parquet(os.path.join(root, "ledger")))
    assert {(r.s3_key.rpartition("/")[2], r.batch_id, r.records_skipped) for r in state.collect()} == {("a.jl", "b3", 1), ("b.JSONL", "b3", 1)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_number_text_is_kept(spark):
    lines = [line(hotelReviewId=1, rating=8.0), '{"hotelId":1,"platform":"Agoda","hotelName":"H","comment":{"hotelReviewId":12,"rating":8,'
             '"reviewDate":"2025-04-10","reviewComments":"x"}}']
    t = parse_lines(lines_df(spark, lines))
    assert [r.rating_text for r in t.orderBy("line_no").collect()] == ["8.0", "8"]


def test_rejects_need_no_join(spark):
    t = E.stage_lines(lines_df(spark, [line(hotel_id=-1, hotelReviewId=1)]), AS_OF)
    assert "Join" not in E.reject_lines(t)._jdf.queryExecution().executedPlan().toString()
    assert E.reject_lines(t).count() == 1


def test_file_result_summary_keeps_last_50_and_shows_10(spark):
    bad = [line(hotel_id=-1, hotelReviewId=i) for i in range(1, 61)]      # 60 invalid lines
    good = [line(hotelReviewId=1000 + i) for i in range(3)]
    t = E.ingest_batch(lines_df(spark, bad + good), AS_OF)
    r = E.file_result(t).collect()[0]
    # last 50 errors are lines 11..60; the summary shows the first 10 of them
    head = "; ".join(f"Line {n}: Hotel ID must be positive" for n in range(11, 21))
    assert r.error_summary == head + "... (+50 more)"
    assert (r.saved_reviews, r.total_errors, r.successful) == (3, 60, False)
    assert abs(r.error_rate - 60 * 100.0 / 63) < 1e-6


def test_all_columns_of_a_review_are_stored(spark):
    extra = {"originalTitle": "Titel", "translateTarget": "en", "formattedReviewDate": "April 10", "isShowReviewResponse": True,
             "checkInDateMonthAndYear": "April 2025", "encryptedReviewData": "x1", "reviewProviderText": "Agoda",
             "responderName": [1], "providerId": 332,
             "reviewerInfo": {"countryName": "Thailand", "flagName": "th", "roomTypeId": 7, "reviewGroupId": "junk", "isShowGlobalIcon": True}}
    r = E.stored_reviews(E.ingest_batch(lines_df(spark, [line(**extra), line(hotelReviewId=2)]), AS_OF)).orderBy("line_no").collect()
    assert (r[0].original_title, r[0].translate_target, r[0].formatted_review_date, r[0].check_in_date_month_and_year) == \
        ("Titel", "en", "April 10", "April 2025")
    assert (r[0].encrypted_review_data, r[0].review_provider_text, r[0].responder_name, r[0].provider_external_id) == ("x1", "Agoda", "[1]", 332)
    assert (r[0].reviewer_flag_name, r[0].room_type_id, r[0].review_group_id) == ("th", 7, None)
    assert (r[0].is_show_review_response, r[0].is_show_global_icon, r[0].is_expert_reviewer) == (True, True, False)
    assert (r[1].original_title, r[1].is_show_review_response, r[1].length_of_stay) == (None, False, 2)


def test_a_row_that_the_store_refuses_has_failed(spark):
    from helpers import DROP
    lines = lines_df(spark, [line(hotelReviewId=1, rating=DROP), line(hotelReviewId=1), line(hotelReviewId=2, reviewTitle="t" * 501)])
    tagged = {r.line_no: r for r in E.ingest_batch(lines, AS_OF).collect()}
    assert [tagged[i].outcome for i in (1, 2, 3)] == ["failed", "valid", "failed"]
    assert tagged[1].line_errors == ["Processing failed - rating is required"]
    assert tagged[3].line_errors == ["Processing failed - review_title exceeds 500 characters"]
    assert E.stored_reviews(E.ingest_batch(lines, AS_OF)).filter("rating is null").count() == 0
