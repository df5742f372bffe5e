"""Validation rules (V0-V17) as one error array per row.

Each rule is a ``when`` that yields its message or null; the array keeps the
non-null messages in rule order, so ``valid = size(errors) == 0``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonfields as J
from ..functions.dates import parse_review_date, shift, ts
from ..functions.text import is_blank, java_trim


def _errors(*rules: Column) -> Column:
    """The non-null messages in rule order.  (Measured: a lambda ``filter``
    keeps this large projection out of whole-stage code generation, which
    here is faster than one generated method too large for the JIT.  The
    lambda is interpreted, so only rows that break a rule come to it.)"""
    broken = reduce(or_, [r.isNotNull() for r in rules])
    return F.when(broken, F.filter(F.array(*rules), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def _number_check(kind: Column, text: Column, *, integral: str, positive_msg: str, number_msg: str) -> Column:
    """Present numeric field: numbers are truncated toward zero (so positive
    means >= 1), text must be a strict integer in range, anything else is
    not a number."""
    as_number = F.when(kind == J.NUMBER, text.try_cast("double"))
    strict_text = J.strict_integer_text(text)
    as_text = F.when((kind == J.STRING) & strict_text, text.try_cast(integral))
    value = F.coalesce(as_number, as_text)
    not_number = (kind.isin(J.BOOLEAN, J.OBJECT, J.ARRAY)
                  | ((kind == J.STRING) & (~strict_text | as_text.isNull())))
    present = kind.isNotNull() & (kind != J.NULL)
    return (F.when(present & not_number, F.lit(number_msg))
            .when(present & (value < 1), F.lit(positive_msg)))


#: The rules in the order of their messages.
RULES = ("hotel", "provider", "name", "rating", "date", "review_id", "comments", "country", "stay")


def rules(as_of: str) -> dict[str, Column]:
    """V1-V10 over the columns of ``parse_lines``: each rule's message, or null."""
    now = ts(as_of)
    hotel_id, provider, hotel_name = F.col("hotel_id"), F.col("provider"), F.col("hotel_name")
    v_hotel = (F.when(hotel_id.isNull(), F.lit(K.MSG_HOTEL_ID_REQUIRED))
               .when(hotel_id <= 0, F.lit(K.MSG_HOTEL_ID_POSITIVE)))
    v_provider = (F.when(provider.isNull(), F.lit(K.MSG_PROVIDER_REQUIRED))
                  .when(java_trim(provider) == "", F.lit(K.MSG_PROVIDER_EMPTY))
                  .when(~provider.isin(*K.VALID_FEED_PROVIDERS), F.lit(K.MSG_PROVIDER_UNKNOWN)))
    v_name = (F.when(hotel_name.isNull(), F.lit(K.MSG_HOTEL_NAME_REQUIRED))
              .when(java_trim(hotel_name) == "", F.lit(K.MSG_HOTEL_NAME_EMPTY))
              .when(F.length(hotel_name) > K.MAX_HOTEL_NAME_LENGTH, F.lit(K.MSG_HOTEL_NAME_TOO_LONG)))
    # rating: optional; numbers and numeric text are checked against [0, 10].
    rk = F.col("rating_kind")
    rating = F.col("rating_value")
    v_rating = (F.when(rk.isin(J.BOOLEAN, J.OBJECT, J.ARRAY), F.lit(K.MSG_RATING_NUMBER))
                .when((rk == J.STRING) & rating.isNull(), F.lit(K.MSG_RATING_NUMBER))
                .when((rating < K.MIN_RATING) | (rating > K.MAX_RATING), F.lit(K.MSG_RATING_RANGE)))
    # review date: required, parseable, not in the future, not older than 20 years.
    dk = F.col("date_kind")
    parsed = F.col("review_date_value")
    present = dk.isNotNull() & (dk != J.NULL)
    v_date = (F.when(~present, F.lit(K.MSG_DATE_REQUIRED))
              .when(parsed.isNull(), F.lit(K.MSG_DATE_FORMAT))
              .when(parsed > now, F.lit(K.MSG_DATE_FUTURE))
              .when(parsed < shift(now, years=-K.MAX_REVIEW_AGE_YEARS), F.lit(K.MSG_DATE_TOO_OLD)))
    v_review_id = _number_check(F.col("hrid_kind"), F.col("hrid_text"), integral="long",
                                positive_msg=K.MSG_REVIEW_ID_POSITIVE, number_msg=K.MSG_REVIEW_ID_NUMBER)
    v_comments = F.when(F.length(F.col("comments_text")) > K.MAX_REVIEW_COMMENTS_LENGTH,
                        F.lit(K.MSG_COMMENTS_TOO_LONG))
    # A child of reviewerInfo is only reachable when reviewerInfo is an
    # object, so a present child kind already implies "reviewerInfo is a map".
    v_country = F.when((F.col("country_kind") == J.STRING) & is_blank(F.col("country_text")),
                       F.lit(K.MSG_COUNTRY_EMPTY))
    v_stay = _number_check(F.col("stay_kind"), F.col("stay_text"), integral="int",
                           positive_msg=K.MSG_STAY_POSITIVE, number_msg=K.MSG_STAY_NUMBER)
    return dict(zip(RULES, (v_hotel, v_provider, v_name, v_rating, v_date, v_review_id, v_comments, v_country, v_stay), strict=True))


def validation_errors(comment_flag: bool = False) -> Column:
    """V0-V10 from the messages of ``rules``, kept as ``_rule_*``.  ``comment_flag``: the
    input carries a boolean ``comment_missing`` column (records built
    without a parsed line); parsed lines always have a comment map."""
    # The parser always yields a comment map (empty when the key is absent),
    # so "Comment section is required" only applies to records built without
    # a parsed line, which carry an explicit ``comment_missing`` flag.
    messages = [F.col(f"_rule_{n}") for n in RULES]
    out = F.when(F.col("v").isNull(), F.array(F.lit(K.MSG_NULL_RECORD)))
    if comment_flag:
        without_comment = _errors(*messages[:3], F.lit(K.MSG_COMMENT_REQUIRED))
        out = out.when(F.coalesce(F.col("comment_missing"), F.lit(False)), without_comment)
    return out.otherwise(_errors(*messages))


def typed_values() -> dict[str, Column]:
    """Rating and review date as values, computed once and shared by the
    rules and the transformation."""
    rk, rt = F.col("rating_kind"), F.col("rating_text")
    return {
        "rating_value": F.when(rk == J.NUMBER, rt.try_cast("double"))
        .when(rk == J.STRING, java_trim(rt).try_cast("double")),
        "review_date_value": parse_review_date(F.col("date_text"), validator=True),
    }


def validate_reviews(parsed: DataFrame, as_of: str) -> DataFrame:
    """Adds ``errors array<string>`` and ``valid`` to parsed, non-blank,
    well-formed lines (blank / malformed lines get an empty array and
    valid = false, they are counted separately)."""
    ok = ~F.col("is_blank") & ~F.col("is_malformed")
    flag = "comment_missing" in parsed.columns
    # The rules come before the lambda over them, which is interpreted and then only reads their messages.  A lambda of
    # its own keeps the rules out of whole-stage code, as one generated method of all is too large for the JIT.
    found = {f"_rule_{n}": r for n, r in rules(as_of).items()}
    parsed = parsed.withColumns(typed_values()).withColumns({**found, "_ok": F.exists(F.array(ok), lambda x: x)})
    errs = F.when(F.col("_ok"), validation_errors(flag)).otherwise(F.array().cast("array<string>"))
    return (parsed.withColumn("errors", errs).withColumn("valid", F.col("_ok") & (F.size("errors") == 0))
            .drop(*found, "_ok"))


def error_breakdown(tagged: DataFrame) -> DataFrame:
    """Validation errors counted by provider and message (over the
    per-line table of the ingest plan, where the rules ran once)."""
    return (tagged.filter(F.col("stage") == "invalid")
            .select(F.col("provider"), F.explode("line_errors").alias("error"))
            .groupBy("provider", "error").agg(F.count(F.lit(1)).alias("error_count")))


def entity_errors(reviews: DataFrame, as_of: str, prefix: str = "") -> Column:
    """The second gate applied to stored review rows; ``prefix`` begins each message."""
    now = ts(as_of)
    gates = [
        F.when(F.col("hotel_id").isNull(), F.lit(prefix + "hotel_id is required")),
        F.when(is_blank(F.col("platform")), F.lit(prefix + "platform is required")),
        F.when(is_blank(F.col("hotel_review_id")), F.lit(prefix + "hotel_review_id is required")),
        F.when(F.col("rating").isNull(), F.lit(prefix + "rating is required")),
        F.when((F.col("rating") < 0) | (F.col("rating") > 10), F.lit(prefix + "rating must be between 0 and 10")),
        F.when(F.col("review_date").isNull(), F.lit(prefix + "review_date is required")),
        F.when(F.col("review_date") > now, F.lit(prefix + "review_date must not be in the future")),
        F.when(F.col("length_of_stay") < 0, F.lit(prefix + "length_of_stay must be >= 0")),
        F.when(F.col("reviewer_review_count") < 0, F.lit(prefix + "reviewer_review_count must be >= 0")),
    ]
    cols = set(reviews.columns)
    for name, limit in K.REVIEW_MAX_LENGTHS:
        stored = "rating_text_label" if name == "rating_text" else name
        if stored in cols:
            gates.append(F.when(F.length(F.col(stored)) > limit, F.lit(prefix + f"{name} exceeds {limit} characters")))
    return _errors(*gates)


def entity_constraints(reviews: DataFrame, as_of: str) -> DataFrame:
    return reviews.withColumn("errors", entity_errors(reviews, as_of))


def provider_constraints(providers: DataFrame) -> DataFrame:
    """Provider rows checked against the entity limits."""
    errs = _errors(
        F.when(is_blank(F.col("name")), F.lit("name is required")),
        F.when(F.length("name") > K.PROVIDER_NAME_MAX, F.lit("name exceeds 100 characters")),
        F.when(F.col("api_endpoint").isNotNull() & ~F.col("api_endpoint").rlike(K.PROVIDER_URL_PATTERN),
               F.lit("api_endpoint must be a valid URL")),
        F.when(F.length("api_endpoint") > K.PROVIDER_ENDPOINT_MAX, F.lit("api_endpoint exceeds 255 characters")),
        F.when((F.col("rating_scale") < 1) | (F.col("rating_scale") > 10), F.lit("rating_scale must be between 1 and 10")),
        F.when(F.length("description") > K.PROVIDER_DESCRIPTION_MAX, F.lit("description exceeds 500 characters")),
        F.when(F.length("supported_languages") > K.PROVIDER_LANGUAGES_MAX,
               F.lit("supported_languages exceeds 200 characters")),
    )
    return providers.withColumn("errors", errs)


def ledger_constraints(ledger: DataFrame) -> DataFrame:
    """Ledger rows checked; duplicate (s3_key, etag) pairs flagged via a
    grouped count joined back on the (unique after grouping) pair."""
    errs = _errors(
        F.when(is_blank(F.col("s3_key")), F.lit("s3_key is required")),
        F.when(F.length("s3_key") > K.LEDGER_KEY_MAX, F.lit("s3_key exceeds 1024 characters")),
        F.when(is_blank(F.col("etag")), F.lit("etag is required")),
        F.when(F.length("etag") > K.LEDGER_ETAG_MAX, F.lit("etag exceeds 255 characters")),
        F.when(F.col("file_size") <= 0, F.lit("file_size must be positive")),
        F.when(F.col("processing_status").isNull() | ~F.col("processing_status").isin(*K.PROCESSING_STATUSES),
               F.lit("processing_status is invalid")),
        F.when((F.col("records_processed") < 0) | (F.col("records_failed") < 0) | (F.col("records_skipped") < 0),
               F.lit("record counts must be >= 0")),
        F.when(F.length("provider") > K.LEDGER_PROVIDER_MAX, F.lit("provider exceeds 50 characters")),
    )
    dups = (ledger.groupBy("s3_key", "etag").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1).select("s3_key", "etag", F.lit(True).alias("_dup")))
    out = ledger.withColumn("errors", errs).join(dups, ["s3_key", "etag"], "left")
    return out.withColumn("errors", F.when(F.col("_dup"), F.array_append("errors", F.lit("duplicate (s3_key, etag)")))
                          .otherwise(F.col("errors"))).drop("_dup")
