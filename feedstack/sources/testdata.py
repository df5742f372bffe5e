"""Adapters from the driver's tables to the review model.

Every adapter is a plain DataFrame plan over the given parquet tables, so
its work grows with them.  The same shapes are written as DuckDB SQL in
``feedstack.plans.oracle`` for the correctness gate; the two must agree
character for character, which is why numbers are rendered to text from
integers and every choice is a CASE on integer keys.

Mapping (lineitem = one review line, orders = one file):
  file       reviews/<o_orderpriority>/order-<o_orderkey>.jl
  line_no    position of the line item within its order (total order over
             all line-item columns)
  hotel      l_partkey / p_name;  provider by l_suppkey mod 4
  review id  l_orderkey*10 + l_linenumber  (natural duplicates exist)
  rating     <round(l_discount*100)>.<round(l_tax*100)>   (0.0 .. 10.8)
  date       l_shipdate in one of three accepted text shapes
  reviewer   c_name / n_name; stay = l_quantity
  defects    one of 14 line shapes by (l_orderkey*31 + l_linenumber*7 + l_partkey) mod 50
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

# FIXED VALUES: clocks of the adapted data sets (used instead of "now").
REVIEW_AS_OF = "2001-06-30 00:00:00"
LEDGER_AS_OF = "2001-08-01 18:00:00"
JOB_AS_OF = "2024-01-31 00:00:00"

FEED_NAMES = ["Agoda", "Booking", "Expedia", "Airbnb"]
FEED_CODES = ["AGODA", "BOOKING", "EXPEDIA", "AIRBNB"]
FEED_EXTERNAL_IDS = [332, 333, 334, 335]
LANGS = ["en", "fr", "de", "es"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key, values):
    """CASE key WHEN 0 THEN values[0] ... (key already reduced mod len)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def _s(c):
    return c.cast("string")


def review_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with everything a review line needs."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation is the fixed 25-row dimension: a proven size bound, so broadcast.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))

    # Lines meet their part, and orders their customer, before lines meet orders: a line goes through two exchanges (part,
    # order) however large the tables are, and the customer's columns travel once for each order, not for each line.
    placed = (orders.join(cust, F.col("o_custkey") == cust.c_custkey)
              .join(nation, F.col("c_nationkey") == nation.n_nationkey))
    joined = li.join(part, li.l_partkey == part.p_partkey).join(placed, li.l_orderkey == F.col("o_orderkey"))
    # Line position inside its file: the window is partitioned by order, the
    # key of the last join, so it adds no exchange.
    order_in_file = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    feed = F.pmod(F.col("l_suppkey"), F.lit(4))
    return joined.select(
        F.concat(F.lit("reviews/"), F.col("o_orderpriority"), F.lit("/order-"),
                 _s(F.col("l_orderkey")), F.lit(".jl")).alias("file_key"),
        F.row_number().over(order_in_file).alias("line_no"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
        F.col("p_name"), F.col("p_type"), F.col("p_brand"),
        F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment"), F.col("n_name"),
        _pick(feed, FEED_NAMES).alias("provider_name"),
        _pick(feed, FEED_CODES).alias("platform"),
        _pick(feed, FEED_EXTERNAL_IDS).alias("external_id"),
        (feed + 1).cast("long").alias("provider_id"),
        F.concat(_s(d), F.lit("."), _s(t)).alias("rating_text"),
        F.concat(_s(d), F.lit("."), _s(t)).cast("double").alias("rating"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hrid"),
        F.col("l_shipdate"),
        F.col("o_orderdate"),
        F.col("l_quantity").cast("int").alias("stay"),
        _pick(F.pmod(F.col("c_nationkey"), F.lit(4)), LANGS).alias("lang"),
        F.concat(F.col("p_type"), F.lit(" room, "), F.lower(F.col("c_mktsegment")),
                 F.lit(" trip  "), F.col("p_name")).alias("comments"),
        F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey"), F.lit(50)).alias("shape"),
    )


def feed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider names of all review lines: one column of ``lineitem``."""
    feed = F.pmod(F.col("l_suppkey"), F.lit(4))
    return table(spark, sf_dir, "lineitem").select(_pick(feed, FEED_NAMES).alias("provider_name"))


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_key, line_no, line): JSON-Lines text as a feed would deliver it."""
    b = review_base(spark, sf_dir)
    k = F.col("shape")
    iso = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    fmt = F.pmod(F.col("l_linenumber"), F.lit(3))
    date_val = (F.when(k == 6, F.date_format("l_shipdate", "yyyy-MM-dd"))
                .when(k == 7, F.date_format("l_shipdate", "dd/MM/yyyy"))
                .when(k == 13, F.concat(iso, F.lit("+07:00[Asia/Bangkok]")))
                .when(fmt == 0, F.concat(iso, F.lit("+07:00")))
                .when(fmt == 1, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
                .otherwise(F.concat(iso, F.lit(".000Z"))))
    hotel_id = F.when(k == 3, F.concat(F.lit('"'), _s(F.col("l_partkey")), F.lit('"'))) \
        .otherwise(_s(F.col("l_partkey")))
    platform = F.when(k == 11, F.lit("")) \
        .otherwise(F.concat(F.lit('"platform":"'), F.col("provider_name"), F.lit('",')))
    hotel_name = F.when(k == 11, F.lit("  ")).otherwise(F.col("p_name"))
    hrid = (F.when(k == 5, F.lit(""))
            .when(k == 10, F.concat(F.lit('"hotelReviewId":"'), _s(F.col("hrid")), F.lit('x",')))
            .when(k == 12, F.lit('"hotelReviewId":0,'))
            .otherwise(F.concat(F.lit('"hotelReviewId":'), _s(F.col("hrid")), F.lit(","))))
    rating = F.when(k == 4, F.concat(F.lit('"'), F.col("rating_text"), F.lit('"'))).otherwise(F.col("rating_text"))
    comments = F.when(k == 8, F.lit("   ")).otherwise(F.col("comments"))
    country = F.when(k == 8, F.lit("")).otherwise(F.col("n_name"))
    stay = (F.when(k == 9, F.lit('"abc"')).when(k == 12, F.lit("0"))
            .otherwise(_s(F.col("stay"))))
    comment_obj = F.concat(
        F.lit("{"), hrid,
        F.lit('"providerId":'), _s(F.col("external_id")),
        F.lit(',"rating":'), rating,
        F.lit(',"reviewDate":"'), date_val,
        F.lit('","reviewTitle":"'), F.col("p_brand"),
        F.lit('","reviewComments":"'), comments,
        F.lit('","translateSource":"'), F.col("lang"),
        F.lit('","reviewerInfo":{"countryName":"'), country,
        F.lit('","displayMemberName":"'), F.col("c_name"),
        F.lit('","lengthOfStay":'), stay,
        F.lit(',"reviewerReviewedCount":'), _s(F.col("l_linenumber")),
        F.lit("}}"))
    comment = F.when(k == 2, F.concat(F.lit('"'), F.col("comments"), F.lit('"'))).otherwise(comment_obj)
    overall = F.concat(
        F.lit('[{"providerId":'), _s(F.col("external_id")),
        F.lit(',"provider":"'), F.col("provider_name"),
        F.lit('","overallScore":'), F.col("rating_text"),
        F.lit(',"reviewCount":'), _s(F.col("l_linenumber")),
        F.lit(',"grades":{"Cleanliness":'), F.col("rating_text"),
        F.lit("}}]"))
    full = F.concat(F.lit('{"hotelId":'), hotel_id, F.lit(","), platform,
                    F.lit('"hotelName":"'), hotel_name, F.lit('","comment":'), comment,
                    F.lit(',"overallByProviders":'), overall, F.lit("}"))
    line = (F.when(k == 0, F.lit(""))
            .when(k == 1, F.expr("substring(full_line, 1, length(full_line) - 2)"))
            .otherwise(F.col("full_line")))
    return (b.withColumn("full_line", full)
            .select("file_key", "line_no", line.alias("line")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review store: one stored review per line item (typed columns)."""
    b = review_base(spark, sf_dir)
    norm = normalize_text(F.col("comments"))
    return b.select(
        (F.col("l_orderkey") * 100 + F.col("line_no")).alias("id"),
        F.col("l_partkey").alias("hotel_id"),
        F.col("p_name").alias("hotel_name"),
        F.col("platform"),
        F.col("provider_id"),
        _s(F.col("external_id")).alias("provider_external_id"),
        _s(F.col("hrid")).alias("hotel_review_id"),
        F.col("rating"),
        F.col("l_shipdate").alias("review_date"),
        F.col("p_brand").alias("review_title"),
        F.col("comments").alias("review_comments"),
        F.col("lang").alias("translate_source"),
        F.col("c_name").alias("reviewer_display_name"),
        F.col("n_name").alias("reviewer_country_name"),
        F.col("stay").alias("length_of_stay"),
        F.col("l_linenumber").alias("reviewer_review_count"),
        F.col("o_orderdate").alias("created_at"),
        F.sha2(F.concat_ws("|", _s(F.col("l_partkey")), norm, F.col("rating_text")), 256).alias("content_hash"),
        F.col("file_key").alias("processed_file_key"),
        F.col("line_no"),
        F.concat(F.col("rating_text"), F.lit(" of 10")).alias("rating_text_label"),
        F.col("p_type").alias("room_type_name"),
        F.lower("c_mktsegment").alias("review_positives"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).alias("review_negatives"),
    )


def processed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file ledger: one file per order."""
    o = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("COMPLETED"))
              .when(F.col("o_orderstatus") == "O", F.lit("FAILED"))
              .otherwise(F.lit("IN_PROGRESS")))
    key = F.concat(F.lit("reviews/"), F.col("o_orderpriority"), F.lit("/order-"),
                   _s(F.col("o_orderkey")), F.lit(".jl"))
    started = F.timestamp_add("HOUR", F.lit(1), F.col("o_orderdate"))
    completed = F.when(status.isin("COMPLETED", "FAILED"),
                       F.timestamp_add("MINUTE", F.pmod(F.col("o_orderkey"), F.lit(120)), started))
    return o.select(
        F.col("o_orderkey").alias("id"),
        key.alias("s3_key"),
        F.md5(_s(F.col("o_orderkey"))).alias("etag"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("file_size"),
        F.col("o_orderdate").alias("last_modified_date"),
        status.alias("processing_status"),
        F.when(status == "COMPLETED", F.pmod(F.col("o_custkey"), F.lit(97))).otherwise(0)
        .cast("int").alias("records_processed"),
        F.when(status == "FAILED", F.pmod(F.col("o_orderkey"), F.lit(7)) + 1).otherwise(0)
        .cast("int").alias("records_failed"),
        F.lit(0).alias("records_skipped"),
        F.when(status == "FAILED", F.concat(F.lit("Failed to process file: "), key)).alias("error_message"),
        _pick(F.pmod(F.col("o_custkey"), F.lit(3)), FEED_NAMES[:3]).alias("provider"),
        F.col("o_orderdate").alias("created_at"),
        F.coalesce(completed, started).alias("updated_at"),
        started.alias("processing_started_at"),
        completed.alias("processing_completed_at"),
    )


def processed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as an event log: every file was tracked, failed once half an hour later, and then came to the state that
    ``processed_files`` has."""
    last = processed_files(spark, sf_dir)
    none, zero = F.lit(None).cast("timestamp_ntz"), F.lit(0)
    first = last.withColumns({
        "id": F.col("id") - 2_000_000_000, "processing_status": F.lit("PENDING"), "updated_at": F.col("created_at"),
        "records_processed": zero, "records_failed": zero, "error_message": F.lit(None).cast("string"),
        "processing_started_at": none, "processing_completed_at": none})
    half = F.timestamp_add("MINUTE", F.lit(30), F.col("created_at"))
    failed = last.withColumns({
        "id": F.col("id") - 1_000_000_000, "processing_status": F.lit("FAILED"), "updated_at": half, "records_processed": zero,
        "records_failed": F.lit(1), "error_message": F.lit("first try"), "processing_started_at": half,
        "processing_completed_at": half})
    return first.unionByName(failed).unionByName(last)


def processing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing jobs: one job per event."""
    e = table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "view", F.lit("COMPLETED"))
              .when(F.col("event_type") == "error", F.lit("FAILED"))
              .when(F.col("event_type") == "click", F.lit("IN_PROGRESS"))
              .when(F.col("event_type") == "signup", F.lit("PENDING"))
              .otherwise(F.lit("CANCELLED")))
    total_files = F.get_json_object("props", "$.k").cast("int")
    processed = (F.when(status == "COMPLETED", total_files)
                 .when(status == "FAILED", F.floor(total_files / 2))
                 .when(status == "IN_PROGRESS", F.floor(total_files / 3))
                 .otherwise(0)).cast("int")
    start = F.when(status != "PENDING", F.col("ts"))
    end = F.when(status.isin("COMPLETED", "FAILED", "CANCELLED"),
                 F.timestamp_add("MILLISECOND", F.round(F.col("value") * 1000).cast("long"), F.col("ts")))
    return e.select(
        F.concat(F.lit("job-"), _s(F.col("event_id"))).alias("processing_id"),
        status.alias("status"),
        _pick(F.pmod(F.col("user_id"), F.lit(4)), FEED_CODES).alias("provider"),
        start.alias("start_time"),
        end.alias("end_time"),
        total_files.alias("total_files"),
        processed.alias("processed_files"),
        F.when(status == "FAILED", total_files - processed).otherwise(0).cast("int").alias("failed_files"),
        F.floor(F.col("value")).cast("int").alias("total_reviews"),
        F.when(status == "FAILED", F.concat(F.lit("Processing failed for event "), _s(F.col("event_id"))))
        .alias("error_message"),
        F.concat(F.lit("user-"), _s(F.col("user_id"))).alias("triggered_by"),
        (F.pmod(F.col("event_id"), F.lit(2)) == 0).alias("is_asynchronous"),
        F.lit("reviews/").alias("s3_prefix"),
        F.lit(100).alias("max_files"),
        F.col("ts").alias("created_at"),
        F.coalesce(end, start, F.col("ts")).alias("updated_at"),
    )


METRIC_NAMES = {"view": "api.requests", "click": "reviews.processed", "purchase": "files.processed",
                "signup": "s3.operations", "error": "validation.errors"}

METER_ENDPOINTS = ["/reviews", "/providers", "/jobs"]
METER_OPERATIONS = ["list", "get", "head", "put"]


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter observations in long format: (metric, provider, status, value, ts)."""
    e = table(spark, sf_dir, "events")
    name = None
    for k, v in METRIC_NAMES.items():
        name = F.when(F.col("event_type") == k, F.lit(v)) if name is None else name.when(F.col("event_type") == k, F.lit(v))
    return e.select(
        name.alias("metric"),
        _pick(F.pmod(F.col("user_id"), F.lit(3)), FEED_CODES[:3]).alias("provider"),
        F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, F.lit("FAILED")).otherwise(F.lit("COMPLETED")).alias("status"),
        F.col("value"),
        F.col("ts"),
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log of jobs: one job for each user and three days, with moves, progress reports and added files."""
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    on = lambda x, value: F.when(kind == x, value)
    return e.select(
        F.concat(F.lit("run-"), _s(F.col("user_id")), F.lit("-"), _s(F.floor(F.dayofmonth("ts") / 3))).alias("processing_id"),
        F.col("ts").alias("event_ts"), n.alias("seq"),
        F.when(kind == "signup", F.lit("PENDING")).when(kind == "click", F.lit("IN_PROGRESS")).when(
            kind == "error", F.when(n % 2 == 0, F.lit("FAILED")).otherwise(F.lit("COMPLETED"))).alias("status"),
        on("view", (k % 10).cast("int")).alias("processed_files"), on("view", (k % 3).cast("int")).alias("failed_files"),
        on("view", F.floor("value").cast("int")).alias("total_reviews"),
        on("purchase", F.concat(F.lit("file-"), _s(n))).alias("file_name"),
        on("purchase", F.when(n % 3 == 0, F.lit("failed")).otherwise(F.lit("processed"))).alias("file_list"))


def meter_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments of counters with the tags that each meter has: (metric, tags, value)."""
    e = table(spark, sf_dir, "events")
    n, user = F.col("event_id"), F.col("user_id")
    provider = (F.lit("provider"), _pick(F.pmod(user, F.lit(3)), FEED_CODES[:3]))
    status = (F.lit("status"), F.when(n % 5 == 0, F.lit("FAILED")).otherwise(F.lit("COMPLETED")))
    meters = {
        "view": ("api.requests.total", (
            F.lit("endpoint"), _pick(F.pmod(n, F.lit(3)), METER_ENDPOINTS),
            F.lit("method"), F.when(user % 2 == 0, F.lit("GET")).otherwise(F.lit("POST")),
            F.lit("status"), F.when(n % 5 == 0, F.lit("500")).otherwise(F.lit("200")))),
        "click": ("reviews.processed.total", (*status, *provider)),
        "purchase": ("files.processed.total", (*status, *provider)),
        "signup": ("s3.operations.total", (
            F.lit("operation"), _pick(F.pmod(n, F.lit(4)), METER_OPERATIONS),
            F.lit("success"), F.when(n % 7 == 0, F.lit("false")).otherwise(F.lit("true")))),
        "error": ("validation.errors.total", (
            *provider, F.lit("error_type"), F.when(n % 2 == 0, F.lit("rating")).otherwise(F.lit("date")))),
    }
    name = tags = None
    for kind, (meter, pairs) in meters.items():
        is_kind = F.col("event_type") == kind
        one = (is_kind, F.lit(meter)), (is_kind, F.create_map(*pairs))
        name, tags = (F.when(*one[0]), F.when(*one[1])) if name is None else (name.when(*one[0]), tags.when(*one[1]))
    count = F.when(F.col("event_type") == "click", F.floor("value")).otherwise(F.lit(1))
    return e.select(name.alias("metric"), tags.alias("tags"), count.cast("long").alias("value"))


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text reviews from ``documents`` (hash / text-normalisation inputs)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("review_comments"),
        F.col("lang").alias("translate_source"),
        F.col("source").alias("hotel_name"),
        F.pmod(F.col("doc_id"), F.lit(997)).alias("hotel_id"),
        (F.pmod(F.col("n_chars"), F.lit(101)) / F.lit(10.0)).cast("double").alias("rating"),
    )
