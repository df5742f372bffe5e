"""Transformation to the stored review shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonfields as J
from ..functions.dates import ts
from ..functions.hashing import line_content_hash
from ..functions.text import sanitize_text, trim_to_null


def provider_code(name) -> Column:
    """Display name -> enum code, case-insensitive; unknown -> null."""
    name = F.col(name) if isinstance(name, str) else name
    low = F.lower(name)
    out = None
    for code, display in K.PROVIDER_TYPES:
        out = F.when(low == display.lower(), F.lit(code)) if out is None else out.when(low == display.lower(), F.lit(code))
    return out


def provider_display(code) -> Column:
    """T11 inverse: code -> display name (case-insensitive); unknown -> null."""
    code = F.col(code) if isinstance(code, str) else code
    up = F.upper(code)
    out = None
    for c, display in K.PROVIDER_TYPES:
        out = F.when(up == c, F.lit(display)) if out is None else out.when(up == c, F.lit(display))
    return out


def transform_failure() -> Column:
    """Message of a valid line that cannot be transformed (no review id)."""
    missing = F.col("hrid_kind").isNull() | (F.col("hrid_kind") == J.NULL)
    return F.when(missing, F.lit(K.MSG_REVIEW_ID_MISSING))


#: (stored column, name in the comment, type); of the comment itself and of its ``reviewerInfo``.
COMMENT_FIELDS = [
    ("provider_external_id", "providerId", "int"), ("formatted_rating", "formattedRating", "string"),
    ("rating_text_label", "ratingText", "string"), ("review_positives", "reviewPositives", "string"),
    ("review_negatives", "reviewNegatives", "string"), ("original_title", "originalTitle", "string"),
    ("original_comment", "originalComment", "string"), ("translate_target", "translateTarget", "string"),
    ("formatted_review_date", "formattedReviewDate", "string"),
    ("check_in_date_month_and_year", "checkInDateMonthAndYear", "string"),
    ("is_show_review_response", "isShowReviewResponse", "boolean"), ("responder_name", "responderName", "string"),
    ("response_date_text", "responseDateText", "string"), ("formatted_response_date", "formattedResponseDate", "string"),
    ("response_translate_source", "responseTranslateSource", "string"),
    ("review_provider_logo", "reviewProviderLogo", "string"), ("review_provider_text", "reviewProviderText", "string"),
    ("encrypted_review_data", "encryptedReviewData", "string"),
]
REVIEWER_FIELDS = [
    ("reviewer_country_id", "countryId", "int"), ("reviewer_flag_name", "flagName", "string"),
    ("review_group_name", "reviewGroupName", "string"), ("review_group_id", "reviewGroupId", "int"),
    ("room_type_name", "roomTypeName", "string"), ("room_type_id", "roomTypeId", "int"),
    ("length_of_stay", "lengthOfStay", "int"), ("reviewer_review_count", "reviewerReviewedCount", "int"),
    ("is_expert_reviewer", "isExpertReviewer", "boolean"), ("is_show_global_icon", "isShowGlobalIcon", "boolean"),
    ("is_show_reviewed_count", "isShowReviewedCount", "boolean"),
]


def _comment() -> Column:
    """The comment with the fields of both lists; one of a wrong type is null
    and leaves the others as they are."""
    # A cast of a variant builds its expression anew for each value, so integers are read from their JSON text.
    listed = lambda fields: ",".join(f"{name}:{'variant' if kind == 'int' else kind}" for _, name, kind in fields)
    own, reviewer = listed(COMMENT_FIELDS), listed(REVIEWER_FIELDS)
    return F.try_variant_get("v", "$.comment", f"struct<{own},reviewerInfo:struct<{reviewer}>>")


def _nested_columns(comment: Column) -> dict[str, Column]:
    """The fields of ``_comment``; a missing flag is false."""
    def read(parent: Column, name: str, kind: str) -> Column:
        if kind == "int":
            return J.variant_int(parent[name])
        return F.coalesce(parent[name], F.lit(False)) if kind == "boolean" else parent[name]

    return {**{c: read(comment, name, kind) for c, name, kind in COMMENT_FIELDS},
            **{c: read(comment["reviewerInfo"], name, kind) for c, name, kind in REVIEWER_FIELDS}}


def transformed_columns(as_of: str) -> dict[str, Column]:
    """T1-T9 column rules over ``validate_reviews`` output (rating and date
    values are the ones the rules already computed)."""
    return {
        "hotel_id": F.col("hotel_id").cast("long"),
        "hotel_name": sanitize_text(F.col("hotel_name")),
        "provider_name": F.col("provider"),
        "platform": provider_code(F.col("provider")),
        "hotel_review_id": F.col("hrid_text"),
        "rating": F.col("rating_value"),
        "review_comments": trim_to_null(F.col("comments_text")),
        "review_date": F.col("review_date_value"),
        "reviewer_display_name": trim_to_null(F.col("reviewer_name_text")),
        "review_title": trim_to_null(F.col("title_text")),
        "translate_source": F.col("translate_source_text"),
        "content_hash": line_content_hash(F.col("hotel_id"), F.col("comments_text"),
                                          F.col("rating_text"), F.col("date_text")),
        "reviewer_country_name": F.col("country_text"),
        # The remaining columns, read from the comment in one pass.
        **_nested_columns(F.col("_comment")),
        "processing_status": F.lit("PROCESSED"),
        "created_at": ts(as_of),
        "updated_at": ts(as_of),
    }


REVIEW_OUTPUT_COLUMNS = [
    "file_key", "line_no", "hotel_id", "hotel_name", "provider_name", "platform", "hotel_review_id",
    "rating", "review_comments", "review_date", "reviewer_display_name", "review_title",
    "translate_source", "content_hash", "reviewer_country_name", *[c for c, _, _ in COMMENT_FIELDS + REVIEWER_FIELDS],
    "processing_status", "created_at", "updated_at",
]


def transform_reviews(validated: DataFrame, as_of: str) -> DataFrame:
    """Valid lines -> review rows; adds ``transform_error`` (null when ok)."""
    # The comment is a projection of its own, so that it is taken apart once for each line.
    out = validated.withColumn("_comment", _comment()).withColumn("transform_error", transform_failure())
    return out.withColumns(transformed_columns(as_of)).drop("_comment")


def review_response(reviews: DataFrame, providers: DataFrame) -> DataFrame:
    """The 15 columns of the API, with the provider's code joined in
    (``providers``: a dimension made by ``sized``, so reviews are not
    shuffled while it is small)."""
    p = providers.select(F.col("code").alias("_code"))
    return reviews.join(p, F.col("platform") == F.col("_code"), "left").select(
        "id", F.col("hotel_id").cast("long").alias("hotel_id"), "hotel_name", F.col("_code").alias("platform"),
        "rating", F.col("rating_text_label").alias("rating_text"), "review_title", "review_comments", "review_date",
        F.col("reviewer_country_name").alias("reviewer_country"), "room_type_name", "length_of_stay",
        "reviewer_display_name", "review_negatives", "review_positives")


def transformed_valid() -> Column:
    """Hotel, provider and the provider's review id are all there."""
    return F.col("hotel_id").isNotNull() & F.col("platform").isNotNull() & F.col("hotel_review_id").isNotNull()


def review_status(failed: Column) -> Column:
    """A review's status after processing."""
    return F.when(failed, F.lit("FAILED")).otherwise(F.lit("PROCESSED"))


def is_processed(status: Column) -> Column:
    """Whether processing is complete; an unknown status is not."""
    return F.coalesce(status == "PROCESSED", F.lit(False))


def status_flags(df: DataFrame, status_col: str) -> DataFrame:
    """Terminal / active / successful / failed flags of a status column."""
    s = F.col(status_col)
    return df.withColumns({
        "is_terminal": s.isin(*K.TERMINAL_STATUSES),
        "is_active": s.isin(*K.ACTIVE_STATUSES),
        "is_successful": s == "COMPLETED",
        "is_failed": s == "FAILED",
    })
