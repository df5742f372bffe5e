"""JSON-Lines parsing.

``parse_lines`` parses each line once (``try_parse_json``) and lifts the
fields the rest of the pipeline needs into flat columns.  Blank and
malformed lines are flagged, never dropped, so counts stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonfields as J
from ..functions.text import java_trim_long, preview

# Flat columns produced by ``parse_lines`` (besides the input columns).
PARSED_COLUMNS = [
    "is_blank", "is_malformed", "v",
    "hotel_id", "provider", "hotel_name",
    "rating_kind", "rating_text",
    "date_kind", "date_text",
    "hrid_kind", "hrid_text",
    "comments_kind", "comments_text",
    "title_text", "reviewer_name_text", "translate_source_text",
    "country_kind", "country_text", "stay_kind", "stay_text",
]

# Scalar fields whose JSON kind matters: (prefix, path).
_TYPED_FIELDS = [
    ("hotel", "$.hotelId"),
    ("provider", "$.platform"),
    ("hotel_name", "$.hotelName"),
    ("rating", "$.comment.rating"),
    ("date", "$.comment.reviewDate"),
    ("hrid", "$.comment.hotelReviewId"),
    ("comments", "$.comment.reviewComments"),
    ("country", "$.comment.reviewerInfo.countryName"),
    ("stay", "$.comment.reviewerInfo.lengthOfStay"),
]

# All of them, and the fields read as text, for one ``try_variant_get``; a parent that is no object has none.
_NODES = ("struct<hotelId:variant,platform:variant,hotelName:variant,comment:struct<"
          "rating:variant,reviewDate:variant,hotelReviewId:variant,reviewComments:variant,"
          "reviewTitle:string,reviewerDisplayName:string,translateSource:string,"
          "reviewerInfo:struct<countryName:variant,lengthOfStay:variant,displayMemberName:string>>>")


def _as_written(node: str, json: str, as_double: str) -> Column:
    """The text that the reader prints for a number, told from its variant; null where only the line can tell (0, which may
    have been -0.0, and integers beyond a long) and for other kinds.  What has a point is a double to the reader;
    without one, a BIGINT was written without one too, and a DECIMAL within a long's range with one."""
    j, double = F.col(json), F.col(as_double)
    kind = F.when(~j.startswith('"'), F.schema_of_variant(node))
    return (F.when(j.contains("."), double.cast("string"))
            .when(kind == "BIGINT", j)
            .when(kind.startswith("DECIMAL") & (double != 0) & (F.abs(double) < 9e18), double.cast("string")))


def parse_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Flag blank/malformed lines and extract typed root and comment
    fields.  A non-object root parses with every field null.

    Each field's sub-value is fetched once; its kind comes from the first
    character of its JSON text, each step in its own projection so no
    expression is evaluated twice per row."""
    out = df.withColumn("_trimmed", java_trim_long(line_col))
    out = out.withColumn("is_blank", F.col("_trimmed").isNull() | (F.col("_trimmed") == ""))
    out = out.withColumn("v", F.when(~F.col("is_blank"), F.try_parse_json("_trimmed")))
    out = out.withColumn("is_malformed", ~F.col("is_blank") & F.col("v").isNull())
    # One walk over the line fetches the values of all fields.
    out = out.withColumn("_nodes", F.try_variant_get("v", "$", _NODES))
    out = out.withColumns({f"_{n}_node": F.col(f"_nodes.{p[2:]}") for n, p in _TYPED_FIELDS})
    out = out.withColumns({f"_{n}_json": F.to_json(F.col(f"_{n}_node")) for n, _ in _TYPED_FIELDS})
    out = out.withColumns({f"{n}_kind": J.kind_of_char(F.substring(f"_{n}_json", 1, 1)) for n, _ in _TYPED_FIELDS})
    # Only a string differs from its JSON text; a cast of a variant builds its expression anew for each value.
    out = out.withColumns({f"_{n}_raw": F.when(F.col(f"{n}_kind") == J.STRING, F.try_variant_get(f"_{n}_node", "$", "string"))
                           .otherwise(F.col(f"_{n}_json")) for n, _ in _TYPED_FIELDS})
    # A variant drops the trailing zeros of a number; the reader prints 8.0 as it is, so these two are taken as written.
    out = out.withColumns({f"_{n}_double": F.col(f"_{n}_json").try_cast("double") for n in ("rating", "hrid")})
    out = out.withColumns({f"_{n}_written": _as_written(f"_{n}_node", f"_{n}_json", f"_{n}_double") for n in ("rating", "hrid")})
    unknown = lambda n: (F.col(f"{n}_kind") == J.NUMBER) & F.col(f"_{n}_written").isNull()
    out = out.withColumn("_numbers", F.when(unknown("rating") | unknown("hrid"), F.from_json(
        "_trimmed", "comment struct<rating:string,hotelReviewId:string>")["comment"]))
    out = out.withColumns({f"_{n}_raw": F.when(F.col(f"{n}_kind") == J.NUMBER, F.coalesce(f"_{n}_written", f"_numbers.{field}", f"_{n}_raw"))
                           .otherwise(F.col(f"_{n}_raw")) for n, field in (("rating", "rating"), ("hrid", "hotelReviewId"))})
    nonnull = lambda n: F.when(F.col(f"{n}_kind") != J.NULL, F.col(f"_{n}_raw"))
    display = F.coalesce("_nodes.comment.reviewerDisplayName", "_nodes.comment.reviewerInfo.displayMemberName")
    out = out.withColumns({
        "hotel_id": J.int_of(F.col("hotel_kind"), F.col("_hotel_raw")),
        "provider": J.text_of(F.col("provider_kind"), F.col("_provider_raw")),
        "hotel_name": J.text_of(F.col("hotel_name_kind"), F.col("_hotel_name_raw")),
        "rating_text": nonnull("rating"),
        "date_text": nonnull("date"),
        "hrid_text": nonnull("hrid"),
        "comments_text": nonnull("comments"),
        "title_text": F.col("_nodes.comment.reviewTitle"),
        "reviewer_name_text": display,
        "translate_source_text": F.col("_nodes.comment.translateSource"),
        "country_text": nonnull("country"),
        "stay_text": nonnull("stay"),
    })
    helpers = [f"_{n}_{x}" for n, _ in _TYPED_FIELDS for x in ("node", "json", "raw", "double", "written")]
    return out.drop(*helpers, "_trimmed", "_nodes", "_numbers", "hotel_kind", "provider_kind", "hotel_name_kind")


def json_scalar_coerce(df: DataFrame, path: str, alias: str, as_type: str = "int") -> DataFrame:
    """A root field coerced the lenient way (``int``) or as text (``string``)."""
    col = J.as_int("v", path) if as_type == "int" else J.as_text("v", path)
    return df.withColumn(alias, col)


def comment_map(df: DataFrame) -> DataFrame:
    """The comment object as ``map<string,variant>`` (values keep their
    JSON type, nested objects included); a missing, null or non-object
    comment gives an empty map (never null)."""
    m = F.try_variant_get("v", "$.comment", "map<string,variant>")
    return df.withColumn("comment_map", F.coalesce(m, F.create_map().cast("map<string,variant>")))


PROVIDER_SCORE_TYPE = ("array<struct<providerId:int,provider:string,overallScore:double,"
                       "reviewCount:int,grades:map<string,double>>>")


def provider_scores(df: DataFrame) -> DataFrame:
    """Explode ``overallByProviders`` (also read under the misspelt
    key ``overallByproviders``) into one row per provider score; null
    elements are dropped."""
    arr = F.coalesce(F.try_variant_get("v", "$.overallByProviders", PROVIDER_SCORE_TYPE),
                     F.try_variant_get("v", "$.overallByproviders", PROVIDER_SCORE_TYPE))
    arr = F.filter(arr, lambda x: x.isNotNull())
    return df.select("*", F.explode(arr).alias("score")).select(
        *[c for c in df.columns if c != "v"],
        F.col("score.providerId").alias("score_provider_id"),
        F.col("score.provider").alias("score_provider"),
        F.col("score.overallScore").alias("overall_score"),
        F.col("score.reviewCount").alias("review_count"),
        F.col("score.grades").alias("grades"),
    )


def parse_stats(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Processed / errors / total lines, success rate and summary text."""
    group_cols = group_cols or []
    processed = F.count_if(~F.col("is_blank") & ~F.col("is_malformed"))
    errors = F.count_if(F.col("is_blank") | F.col("is_malformed"))
    total = F.count(F.lit(1))
    agg = df.groupBy(*group_cols).agg(processed.alias("processed_count"),
                                      errors.alias("error_count"),
                                      total.alias("total_lines"))
    return agg.withColumns({
        "has_errors": F.col("error_count") > 0,
        "success_rate": F.when(F.col("total_lines") > 0,
                               F.round(F.col("processed_count") * F.lit(100.0) / F.col("total_lines"), 6))
        .otherwise(F.lit(0.0)),
        "summary": F.format_string("Processed: %d, Errors: %d, Total Lines: %d",
                                   "processed_count", "error_count", "total_lines"),
    })


def parse_errors(df: DataFrame, line_col: str = "line") -> DataFrame:
    """One error record per blank or malformed line: line number, the
    text cut to 100 chars + '...', the whole text, and the message."""
    bad = df.filter(F.col("is_blank") | F.col("is_malformed"))
    return bad.select(
        "file_key", "line_no",
        preview(F.col(line_col), K.ERROR_LINE_PREVIEW).alias("line_preview"), F.col(line_col).alias("line_text"),
        F.when(F.col("is_blank"), F.lit("Blank line")).otherwise(F.lit("Malformed JSON")).alias("error"),
    )
