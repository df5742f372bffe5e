"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Every builder reads the driver's tables through the adapters, so its work
grows with the data; filters below are the operators' own parameters.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import hashing as H
from ..functions import rows as R
from ..functions.text import has_text
from ..operators import dedup, job_log, ledger, parse, query, stats, validate
from ..operators.transform import provider_display
from ..session import staged
from ..sources import providers as P
from ..sources import states, tables
from ..sources import testdata as TD
from . import ingest as E
from .oracle import jtrim, norm_text, with_ctes

Builder = Callable[[SparkSession, str], DataFrame]


@dataclasses.dataclass(frozen=True)
class Query:
    key: str
    build: Builder
    sql: str | None


REGISTRY: list[Query] = []


def register(key: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY.append(Query(key, fn, sql))
        return fn
    return deco


AS_OF = TD.REVIEW_AS_OF


def _tagged(spark, sf):
    return E.ingest_batch(TD.review_lines(spark, sf), AS_OF)


def _staged(spark, sf):
    return E.stage_lines(TD.review_lines(spark, sf), AS_OF)


def _providers(spark, sf):
    return P.sized(P.lookup_or_create(spark, TD.feed_names(spark, sf)))


# ----------------------------------------------------------------------------
# Ingest pipeline (J, V, T, W1, E, K2, A22)
# ----------------------------------------------------------------------------

@register("ingest_batch", with_ctes(["staged"], """
SELECT file_key, line_no, outcome, CAST(len(line_errors) AS BIGINT) AS n_errors FROM tagged"""))
def q_ingest_batch(spark, sf):
    t = _tagged(spark, sf)
    return t.select("file_key", "line_no", "outcome", F.size("line_errors").cast("long").alias("n_errors"))


@register("write_rejects", with_ctes(["staged"], """
SELECT file_key, line_no, CAST(i - 1 AS BIGINT) AS error_pos,
       'Line ' || CAST(line_no AS VARCHAR) || ': ' || line_errors[i] AS error
FROM tagged, unnest(range(1, len(line_errors) + 1)) AS r(i)"""))
def q_write_rejects(spark, sf):
    return E.reject_lines(_staged(spark, sf)).withColumn("error_pos", F.col("error_pos").cast("long"))


_STORED_SQL = """
stored AS (SELECT platform, rating_value AS rating, review_date FROM tagged WHERE outcome = 'valid')"""


@register("platform_statistics", with_ctes(["staged"], f""",{_STORED_SQL.strip()}
SELECT platform, count(*) AS review_count, round(avg(rating), 6) AS average_rating,
       min(rating) AS min_rating, max(rating) AS max_rating,
       min(review_date) AS first_review_date, max(review_date) AS last_review_date,
       count(*) FILTER (WHERE rating >= 7.0) AS positive_count,
       count(*) FILTER (WHERE rating >= 5.0 AND rating < 7.0) AS neutral_count,
       count(*) FILTER (WHERE rating < 5.0) AS negative_count
FROM stored GROUP BY platform""".replace("WITH ,", "WITH ")))
def q_platform_statistics(spark, sf):
    return stats.platform_statistics(E.stored_reviews(_tagged(spark, sf)))


@register("batch_result", with_ctes(["staged"], """
SELECT file_key, count(*) AS total_lines,
       count(*) FILTER (WHERE outcome NOT IN ('blank', 'malformed')) AS processed_count,
       count(*) FILTER (WHERE outcome = 'valid') AS valid_count,
       count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) AS invalid_count,
       count(*) FILTER (WHERE outcome = 'failed') AS failed_count,
       count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_count,
       count(*) FILTER (WHERE outcome = 'blank') AS blank_count,
       count(*) FILTER (WHERE outcome = 'malformed') AS malformed_count,
       CAST(sum(len(line_errors)) AS BIGINT) AS error_count,
       CASE WHEN count(*) FILTER (WHERE outcome NOT IN ('blank', 'malformed')) = 0 THEN 'COMPLETED'
            WHEN count(*) FILTER (WHERE outcome = 'valid') = 0 THEN 'FAILED'
            WHEN count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) > 0 OR sum(len(line_errors)) > 0 THEN 'FAILED'
            ELSE 'COMPLETED' END AS status
FROM tagged GROUP BY file_key"""))
def q_batch_result(spark, sf):
    return E.batch_result(_tagged(spark, sf))


_STORED = ("file_key line_no hotel_id hotel_name provider_name platform hotel_review_id rating review_date review_comments "
           "review_title reviewer_display_name translate_source content_hash reviewer_country_name provider_external_id "
           "length_of_stay reviewer_review_count is_expert_reviewer is_show_review_response original_title processing_status").split()


@register("transformed_reviews", with_ctes(["staged"], f"""
SELECT file_key, line_no, CAST(hotel_id AS BIGINT) AS hotel_id, regexp_replace({jtrim('hotel_name')}, '\\s+', ' ', 'g') AS hotel_name,
       provider AS provider_name, platform, hotel_review_id, rating_value AS rating, review_date, review_comments,
       json_extract_string(j, '$.comment.reviewTitle') AS review_title,
       json_extract_string(j, '$.comment.reviewerInfo.displayMemberName') AS reviewer_display_name,
       json_extract_string(j, '$.comment.translateSource') AS translate_source, content_hash,
       json_extract_string(j, '$.comment.reviewerInfo.countryName') AS reviewer_country_name,
       CAST(json_extract_string(j, '$.comment.providerId') AS INTEGER) AS provider_external_id,
       TRY_CAST(json_extract_string(j, '$.comment.reviewerInfo.lengthOfStay') AS INTEGER) AS length_of_stay,
       CAST(json_extract_string(j, '$.comment.reviewerInfo.reviewerReviewedCount') AS INTEGER) AS reviewer_review_count,
       false AS is_expert_reviewer, false AS is_show_review_response, CAST(NULL AS VARCHAR) AS original_title,
       'PROCESSED' AS processing_status
FROM tagged WHERE outcome = 'valid'"""))
def q_transformed_reviews(spark, sf):
    return E.stored_reviews(_tagged(spark, sf)).select(*_STORED)


@register("error_breakdown", with_ctes(["staged"], """
SELECT provider, error, count(*) AS error_count
FROM (SELECT provider, unnest(errors) AS error FROM tagged WHERE stage = 'invalid')
GROUP BY provider, error"""))
def q_error_breakdown(spark, sf):
    return validate.error_breakdown(_staged(spark, sf))


@register("parse_stats", with_ctes(["parsed"], """
SELECT file_key, count(*) FILTER (WHERE NOT is_blank AND NOT is_malformed) AS processed_count,
       count(*) FILTER (WHERE is_blank OR is_malformed) AS error_count, count(*) AS total_lines,
       count(*) FILTER (WHERE is_blank OR is_malformed) > 0 AS has_errors,
       round(count(*) FILTER (WHERE NOT is_blank AND NOT is_malformed) * 100.0 / count(*), 6) AS success_rate,
       'Processed: ' || CAST(count(*) FILTER (WHERE NOT is_blank AND NOT is_malformed) AS VARCHAR)
         || ', Errors: ' || CAST(count(*) FILTER (WHERE is_blank OR is_malformed) AS VARCHAR)
         || ', Total Lines: ' || CAST(count(*) AS VARCHAR) AS summary
FROM parsed GROUP BY file_key"""))
def q_parse_stats(spark, sf):
    return parse.parse_stats(parse.parse_lines(TD.review_lines(spark, sf)), ["file_key"])


@register("parse_errors", with_ctes(["parsed"], """
SELECT file_key, line_no,
       CASE WHEN length(line) > 100 THEN substr(line, 1, 100) || '...' ELSE line END AS line_preview, line AS line_text,
       CASE WHEN is_blank THEN 'Blank line' ELSE 'Malformed JSON' END AS error
FROM parsed WHERE is_blank OR is_malformed"""))
def q_parse_errors(spark, sf):
    return parse.parse_errors(parse.parse_lines(TD.review_lines(spark, sf)))


@register("provider_scores", with_ctes(["parsed"], """
SELECT json_extract_string(s, '$.provider') AS score_provider, count(*) AS score_rows,
       round(avg(CAST(json_extract(s, '$.overallScore') AS DOUBLE)), 6) AS average_overall_score,
       CAST(sum(CAST(json_extract(s, '$.reviewCount') AS INTEGER)) AS BIGINT) AS total_review_count,
       round(avg(CAST(json_extract(s, '$.grades.Cleanliness') AS DOUBLE)), 6) AS average_cleanliness
FROM (SELECT unnest(CAST(json_extract(j, '$.overallByProviders') AS JSON[])) AS s FROM parsed WHERE j IS NOT NULL)
GROUP BY 1"""))
def q_provider_scores(spark, sf):
    s = parse.provider_scores(parse.parse_lines(TD.review_lines(spark, sf)))
    return s.groupBy("score_provider").agg(
        F.count(F.lit(1)).alias("score_rows"),
        F.round(F.avg("overall_score"), 6).alias("average_overall_score"),
        F.sum("review_count").cast("long").alias("total_review_count"),
        F.round(F.avg(F.col("grades")["Cleanliness"]), 6).alias("average_cleanliness"))


@register("file_result", with_ctes(["staged"], """
SELECT file_key, valid AS saved_reviews, bad + lost AS total_errors, bad AS validation_errors, lost AS transformation_errors,
       CASE WHEN valid + bad + lost > 0 THEN round((bad + lost) * 100.0 / (valid + bad + lost), 6) ELSE 0.0 END AS error_rate,
       valid > 0 AND bad + lost = 0 AND n_errors = 0 AS successful,
       'File: ' || file_key || ', Saved: ' || valid || ', Errors: ' || (bad + lost) || ' (V:' || bad || ', T:' || lost
         || ', P:0, D:0)' AS summary,
       CASE WHEN n_errors > 0 THEN array_to_string(texts[greatest(1, len(texts) - 49):][:10], '; ')
         || CASE WHEN n_errors > 10 THEN '... (+' || (n_errors - 10) || ' more)' ELSE '' END END AS error_summary
FROM (SELECT file_key, count(*) FILTER (WHERE outcome = 'valid') AS valid, count(*) FILTER (WHERE outcome = 'invalid') AS bad,
             count(*) FILTER (WHERE outcome = 'failed') AS lost, CAST(sum(len(line_errors)) AS BIGINT) AS n_errors,
             flatten(list(list_transform(line_errors, lambda e: 'Line ' || line_no || ': ' || e) ORDER BY line_no)) AS texts
      FROM tagged GROUP BY file_key)"""))
def q_file_result(spark, sf):
    r = E.file_result(_tagged(spark, sf))
    return r.select("file_key", "saved_reviews", "total_errors", "validation_errors", "transformation_errors", "error_rate",
                    "successful", "summary", "error_summary")


@register("chunk_total", with_ctes(["staged"], """
SELECT file_key, count(DISTINCT floor((line_no - 1) / 2)) AS chunks,
       CAST(count(*) FILTER (WHERE outcome NOT IN ('blank', 'malformed')) AS BIGINT) AS processed_count,
       count(*) FILTER (WHERE outcome = 'valid') AS valid_count,
       count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) AS invalid_count,
       count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_count, CAST(sum(len(line_errors)) AS BIGINT) AS error_count,
       CASE WHEN count(*) FILTER (WHERE outcome NOT IN ('blank', 'malformed')) = 0 THEN 'COMPLETED'
            WHEN count(*) FILTER (WHERE outcome = 'valid') = 0 THEN 'FAILED'
            WHEN count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) > 0 OR sum(len(line_errors)) > 0 THEN 'FAILED'
            ELSE 'COMPLETED' END AS status
FROM tagged GROUP BY file_key"""))
def q_chunk_total(spark, sf):
    return E.chunk_total(E.chunk_rollup(_tagged(spark, sf), chunk_size=2))


@register("chunk_rollup", with_ctes(["staged"], """
SELECT file_key, CAST(floor((line_no - 1) / 2) AS BIGINT) AS chunk_id, count(*) AS total_lines,
       count(*) FILTER (WHERE outcome = 'valid') AS valid_count,
       count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) AS invalid_count
FROM tagged GROUP BY 1, 2"""))
def q_chunk_rollup(spark, sf):
    r = E.chunk_rollup(_tagged(spark, sf), chunk_size=2)
    return r.select("file_key", F.col("chunk_id").cast("long").alias("chunk_id"), "total_lines", "valid_count",
                    "invalid_count")


# ----------------------------------------------------------------------------
# Review store: filters, finders, paging, joins, dedup, aggregates
# ----------------------------------------------------------------------------

_F9 = query.ReviewFilter(platform="agoda", min_rating=5.0, max_rating=9.5, hotel_name="ring",
                         start_date="1996-01-01", end_date="1999-12-31", min_length_of_stay=5,
                         max_length_of_stay=40)


@register("filter_all", with_ctes(["reviews"], """
SELECT id, hotel_id, platform, rating, review_date FROM reviews
WHERE platform = 'AGODA' AND rating >= 5.0 AND rating <= 9.5 AND contains(lower(hotel_name), 'ring')
  AND review_date >= TIMESTAMP '1996-01-01 00:00:00' AND review_date <= TIMESTAMP '1999-12-31 23:59:59'
  AND length_of_stay >= 5 AND length_of_stay <= 40"""))
def q_filter_all(spark, sf):
    return query.apply_filters(TD.reviews(spark, sf), _F9).select("id", "hotel_id", "platform", "rating", "review_date")


@register("filter_country_hotel", with_ctes(["reviews"], """
SELECT id, hotel_id, reviewer_country_name FROM reviews WHERE hotel_id = 4 AND reviewer_country_name = 'NATION_3'"""))
def q_filter_country_hotel(spark, sf):
    f = query.ReviewFilter(hotel_id=4, reviewer_country="NATION_3")
    return query.apply_filters(TD.reviews(spark, sf), f).select("id", "hotel_id", "reviewer_country_name")


@register("search_reviews", with_ctes(["reviews"], """
SELECT id, hotel_name, review_title FROM reviews
WHERE contains(lower(review_comments), 'medium room, building') OR contains(lower(review_title), 'medium room, building')
   OR contains(lower(hotel_name), 'medium room, building')"""))
def q_search_reviews(spark, sf):
    f = query.ReviewFilter(search="MEDIUM room, BUILDING")
    return query.apply_filters(TD.reviews(spark, sf), f).select("id", "hotel_name", "review_title")


@register("page_reviews", with_ctes(["reviews"], """
SELECT id, review_date, rating FROM reviews WHERE platform = 'BOOKING'
ORDER BY review_date DESC NULLS FIRST, id LIMIT 20 OFFSET 60"""))
def q_page_reviews(spark, sf):
    r = query.apply_filters(TD.reviews(spark, sf), query.ReviewFilter(platform="BOOKING"))
    return query.page(r, page_no=3, size=20).select("id", "review_date", "rating")


@register("page_deep", with_ctes(["reviews"], """
SELECT page, id, review_date, rating FROM (
  SELECT *, (row_number() OVER (ORDER BY review_date DESC NULLS FIRST, id) - 1) // 20 AS page FROM reviews)
WHERE page IN (0, 700, 2000)"""))
def q_page_deep(spark, sf):
    """Pages far down, each narrowed down to at most 2,000 rows before anything is sorted.  The three columns are
    written once, since every step of every page reads them."""
    r = staged(TD.reviews(spark, sf).select("id", "review_date", "rating"), "pages")
    pages = [query.page_deep(r, no, 20, rows=2000).select(F.lit(no).cast("long").alias("page"), "*") for no in (0, 700, 2000)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@register("page_info", with_ctes(["reviews"], """
SELECT count(*) AS total_elements, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages
FROM reviews WHERE platform = 'BOOKING'"""))
def q_page_info(spark, sf):
    r = query.apply_filters(TD.reviews(spark, sf), query.ReviewFilter(platform="BOOKING"))
    return query.page_info(r, size=20)


@register("page_keyset", with_ctes(["reviews"], """
SELECT id, review_date FROM reviews
WHERE review_date < TIMESTAMP '1998-06-01 00:00:00' OR (review_date = TIMESTAMP '1998-06-01 00:00:00' AND id > 5000)
ORDER BY review_date DESC NULLS FIRST, id LIMIT 20"""))
def q_page_keyset(spark, sf):
    return query.page_after(TD.reviews(spark, sf), "1998-06-01 00:00:00", 5000, 20).select("id", "review_date")


@register("page_first", with_ctes(["reviews"], """
SELECT id, review_date FROM (SELECT id, CASE WHEN id % 3001 > 0 THEN review_date END AS review_date FROM reviews)
ORDER BY review_date DESC NULLS FIRST, id LIMIT 20"""))
def q_page_first(spark, sf):
    """P2 from the start, over reviews of which some have no date."""
    r = TD.reviews(spark, sf).withColumn("review_date", F.when(F.col("id") % 3001 > 0, F.col("review_date")))
    return query.page_after(r, size=20).select("id", "review_date")


@register("hotel_language_page", with_ctes(["reviews"], """
SELECT id, review_date FROM reviews WHERE hotel_id = 4 AND translate_source = 'es'
ORDER BY review_date DESC NULLS FIRST, id LIMIT 5 OFFSET 5"""))
def q_hotel_language_page(spark, sf):
    return query.hotel_language_page(TD.reviews(spark, sf), 4, "es", page_no=1, size=5).select("id", "review_date")


@register("review_by_id", with_ctes(["reviews"], """
SELECT id, hotel_id, platform, rating FROM reviews WHERE id = (SELECT max(id) FROM reviews)"""))
def q_review_by_id(spark, sf):
    r = TD.reviews(spark, sf)
    return query.review_by_id(r, r.agg(F.max("id")).first()[0]).select("id", "hotel_id", "platform", "rating")


@register("review_file_join", with_ctes(["reviews", "ledger"], """
SELECT r.id, r.processed_file_key, f.etag, f.processing_status AS file_status
FROM reviews r LEFT JOIN processed_files f ON r.processed_file_key = f.s3_key AND f.id % 10 > 0"""))
def q_review_file_join(spark, sf):
    """Over the whole ledger; a tenth of its files is stored under another key."""
    moved = F.when(F.col("id") % 10 > 0, F.col("s3_key")).otherwise(F.concat("s3_key", F.lit(".moved")))
    files = ledger.current_state(TD.processed_files(spark, sf).withColumn("s3_key", moved))
    return query.review_files(TD.reviews(spark, sf), files).select("id", "processed_file_key", "etag", "file_status")


@register("review_statistics", with_ctes(["reviews"], """
SELECT count(*) AS total_reviews, coalesce(round(avg(rating), 6), 0.0) AS average_rating
FROM reviews WHERE platform = 'EXPEDIA' AND rating >= 3.0"""))
def q_review_statistics(spark, sf):
    r = query.apply_filters(TD.reviews(spark, sf), query.ReviewFilter(platform="EXPEDIA", min_rating=3.0))
    return stats.review_statistics(r)


@register("review_totals", with_ctes(["reviews"], f"""
SELECT count(*) AS total_reviews,
       count(*) FILTER (WHERE review_date BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59') AS reviews_in_range,
       round(avg(rating), 6) AS average_rating,
       count(*) FILTER (WHERE created_at < TIMESTAMP '{AS_OF}') AS created_before
FROM reviews"""))
def q_review_totals(spark, sf):
    return stats.totals(TD.reviews(spark, sf), AS_OF, "1997-01-01", "1997-12-31")


@register("avg_rating_by_hotel", with_ctes(["reviews"], """
SELECT hotel_id, count(*) AS review_count, round(avg(rating), 6) AS average_rating FROM reviews GROUP BY hotel_id"""))
def q_avg_rating_by_hotel(spark, sf):
    return stats.by_hotel(TD.reviews(spark, sf))


_PROVIDERS_SQL = f"""
providers AS (
  SELECT * FROM (VALUES {", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {str(r[4]).lower()}, {r[5]}, '{r[6]}', '{r[7]}', '{r[8]}')" for r in P.SEED_ROWS)})
    AS t(id, name, code, external_id, is_active, rating_scale, supported_languages, api_endpoint, provider_type)
  UNION ALL
  SELECT CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT), name, upper(name), NULL, true, 5.0, 'en', NULL, 'HOTEL_BOOKING'
  FROM (SELECT DISTINCT provider_name AS name FROM base)
  WHERE name NOT IN ({", ".join(f"'{r[1]}'" for r in P.SEED_ROWS)})
)"""


def _with_providers(body: str, extra: list[str] | None = None) -> str:
    return with_ctes(["reviews", *(extra or [])], "", AS_OF).rstrip() + "," + _PROVIDERS_SQL.strip() + "\n" + body


@register("count_by_provider", _with_providers("""
SELECT p.code AS platform, p.name AS provider_name, coalesce(r.review_count, 0) AS review_count,
       coalesce(r.average_rating, 0.0) AS average_rating
FROM providers p LEFT JOIN (SELECT platform, count(*) AS review_count, round(avg(rating), 6) AS average_rating
                            FROM reviews GROUP BY platform) r ON p.code = r.platform"""))
def q_count_by_provider(spark, sf):
    return stats.by_provider(TD.reviews(spark, sf), _providers(spark, sf))


@register("provider_counts", _with_providers("""
SELECT count(*) AS total_providers, count(*) FILTER (WHERE is_active) AS active_providers,
       count(*) FILTER (WHERE external_id IS NULL) AS created_providers FROM providers"""))
def q_provider_counts(spark, sf):
    p = _providers(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("total_providers"), F.count_if("is_active").alias("active_providers"),
                 F.count_if(F.col("external_id").isNull()).alias("created_providers"))


@register("providers_active", _with_providers("""
SELECT name, code, rating_scale, supported_languages, provider_type FROM providers WHERE is_active AND name <> 'Booking' ORDER BY name"""))
def q_providers_active(spark, sf):
    p = P.set_active(_providers(spark, sf), "Booking", False)
    return P.providers_active(p).select("name", "code", "rating_scale", "supported_languages", "provider_type")


@register("ingest_providers", with_ctes(["staged"], f"""
SELECT * FROM (VALUES {", ".join(f"('{x[1]}', '{x[2]}', {x[5]}, '{x[6]}', '{x[8]}')" for x in P.SEED_ROWS)})
  AS t(name, code, rating_scale, supported_languages, provider_type)
UNION ALL
SELECT DISTINCT provider, upper(provider), 5.0, 'en', 'HOTEL_BOOKING' FROM tagged
WHERE stage = 'candidate' AND provider NOT IN ({", ".join(f"'{x[1]}'" for x in P.SEED_ROWS)})"""))
def q_ingest_providers(spark, sf):
    """X2 within E1: only names of valid lines create a provider."""
    names = _staged(spark, sf).filter(F.col("stage") == "candidate").select("provider_name")
    return P.lookup_or_create(spark, names).select("name", "code", "rating_scale", "supported_languages", "provider_type")


@register("provider_lookup", _with_providers("""
SELECT id, name, code, external_id, is_active FROM providers
WHERE code = 'AIRBNB' OR contains(upper(name), 'BOOK') OR external_id = '334'"""))
def q_provider_lookup(spark, sf):
    p = _providers(spark, sf)
    return p.filter((F.col("code") == "AIRBNB") | F.contains(F.upper("name"), F.lit("BOOK"))
                    | (F.col("external_id") == "334")).select("id", "name", "code", "external_id", "is_active")


@register("provider_by_name", _with_providers("""
SELECT n.name, coalesce(p.code, '') AS code, p.id IS NOT NULL AS name_exists
FROM (SELECT provider_name AS name FROM base UNION SELECT upper(provider_name) FROM base) n LEFT JOIN providers p ON p.name = n.name"""))
def q_provider_by_name(spark, sf):
    names = TD.feed_names(spark, sf).select(F.explode(F.array("provider_name", F.upper("provider_name"))).alias("name"))
    return query.providers_by_name(_providers(spark, sf), names).select(
        "name", F.coalesce("code", F.lit("")).alias("code"), "name_exists")


@register("normalize_and_language", _with_providers("""
SELECT r.id, round(CASE WHEN p.rating_scale IS NULL OR p.rating_scale <= 0 THEN r.rating
                        ELSE r.rating / p.rating_scale * 5.0 END, 6) AS normalized_rating,
       coalesce(p.supported_languages IS NOT NULL AND r.translate_source IS NOT NULL AND
                list_contains(list_transform(string_split(lower(p.supported_languages), ','), x -> trim(x)),
                              lower(r.translate_source)), false) AS supports_language
FROM reviews r JOIN providers p ON r.platform = p.code""".replace("x -> trim(x)", "lambda x: trim(x)")))
def q_normalize_and_language(spark, sf):
    p = _providers(spark, sf).select(F.col("code").alias("platform"), "rating_scale", "supported_languages")
    r = TD.reviews(spark, sf).join(p, "platform")
    return r.select("id", F.round(R.normalize_rating("rating", "rating_scale"), 6).alias("normalized_rating"),
                    R.supports_language("supported_languages", "translate_source").alias("supports_language"))


@register("recent_by_provider", _with_providers("""
SELECT r.id, r.review_date FROM reviews r JOIN providers p ON r.platform = p.code
WHERE p.code = 'EXPEDIA' AND r.review_date > TIMESTAMP '2001-01-01 00:00:00'"""))
def q_recent_by_provider(spark, sf):
    return query.recent_by_provider(TD.reviews(spark, sf), _providers(spark, sf), "EXPEDIA",
                                    "2001-01-01 00:00:00").select("id", "review_date")


@register("potential_duplicates", with_ctes(["reviews"], """
SELECT id, hotel_id, content_hash FROM reviews
WHERE (hotel_id, content_hash) IN (SELECT hotel_id, content_hash FROM reviews GROUP BY 1, 2 HAVING count(*) > 1)"""))
def q_potential_duplicates(spark, sf):
    """The three columns are written once, since the groups and the rows read them; a hash in hex takes half the space with zstd."""
    r = staged(TD.reviews(spark, sf).select("id", "hotel_id", "content_hash"), "keys", "zstd")
    return dedup.potential_duplicates(r).select("id", "hotel_id", "content_hash")


@register("dedup_in_batch", with_ctes(["reviews"], """
SELECT platform, hotel_review_id, min(id) AS first_id, count(*) AS copies FROM reviews GROUP BY 1, 2"""))
def q_dedup_in_batch(spark, sf):
    r = TD.reviews(spark, sf)
    first = dedup.first_per_key(r, dedup.REVIEW_KEY, ["id"])
    copies = r.groupBy(*dedup.REVIEW_KEY).agg(F.count(F.lit(1)).alias("copies"))
    return first.withColumnRenamed("id", "first_id").join(copies, dedup.REVIEW_KEY)


@register("dedup_against_store", with_ctes(["staged", "reviews"], """
SELECT t.file_key, t.line_no, t.platform, t.hotel_review_id FROM tagged t
WHERE t.outcome = 'valid' AND NOT EXISTS (
  SELECT 1 FROM reviews r WHERE r.platform = t.platform AND r.hotel_review_id = t.hotel_review_id
    AND r.created_at < TIMESTAMP '1996-01-01 00:00:00')"""))
def q_dedup_against_store(spark, sf):
    store = TD.reviews(spark, sf).filter(F.col("created_at") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    valid = E.stored_reviews(_tagged(spark, sf))
    return dedup.dedup_against_store(valid, store).select("file_key", "line_no", "platform", "hotel_review_id")


@register("named_finders", with_ctes(["reviews"], """
SELECT id, 'by_language' AS finder FROM reviews WHERE translate_source = 'de'
UNION ALL SELECT id, 'by_reviewer' FROM reviews WHERE reviewer_display_name = 'Customer#000000377'
UNION ALL SELECT id, 'rating_between' FROM reviews WHERE rating BETWEEN 3.0 AND 4.0
UNION ALL SELECT id, 'date_between' FROM reviews WHERE review_date BETWEEN TIMESTAMP '1999-03-01 00:00:00' AND TIMESTAMP '1999-03-31 00:00:00'
UNION ALL SELECT id, 'hotel_min_rating' FROM reviews WHERE hotel_id = 1317 AND rating >= 5.0
UNION ALL SELECT id, 'hotel_name_contains' FROM reviews WHERE contains(lower(hotel_name), 'widget')
UNION ALL SELECT id, 'high_rated' FROM reviews WHERE rating > 9.5
UNION ALL SELECT id, 'recent_reviews' FROM reviews WHERE created_at >= TIMESTAMP '2001-06-01 00:00:00'
UNION ALL SELECT id, 'created_between' FROM reviews WHERE created_at BETWEEN TIMESTAMP '1995-02-01 00:00:00' AND TIMESTAMP '1995-02-28 00:00:00'
UNION ALL SELECT id, 'by_hotel' FROM reviews WHERE hotel_id = 42
UNION ALL SELECT id, 'by_provider' FROM reviews WHERE platform = 'EXPEDIA'
UNION ALL SELECT id, 'hotel_and_provider' FROM reviews WHERE hotel_id = 1317 AND provider_id = 2
UNION ALL SELECT id, 'rating_at_least' FROM reviews WHERE rating >= 9.0
UNION ALL SELECT id, 'complex_criteria' FROM reviews WHERE hotel_id = 1317 AND review_date BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2001-12-31 00:00:00' AND rating >= 5.0"""))
def q_named_finders(spark, sf):
    """Every finder of the store in one pass."""
    return query.matches(TD.reviews(spark, sf), {
        "by_language": query.equal(translate_source="de"),
        "by_reviewer": query.equal(reviewer_display_name="Customer#000000377"),
        "by_provider": query.equal(platform="EXPEDIA"),
        "by_hotel": query.equal(hotel_id=42),
        "hotel_and_provider": query.equal(hotel_id=1317, provider_id=2),
        "rating_at_least": query.at_least("rating", 9.0),
        "rating_between": query.between("rating", 3.0, 4.0),
        "date_between": query.time_between("review_date", "1999-03-01 00:00:00", "1999-03-31 00:00:00"),
        "created_between": query.time_between("created_at", "1995-02-01 00:00:00", "1995-02-28 00:00:00"),
        "hotel_min_rating": query.equal(hotel_id=1317) & query.at_least("rating", 5.0),
        "hotel_name_contains": query.contains_ci("hotel_name", "Widget"),
        "high_rated": F.col("rating") > 9.5,
        "recent_reviews": query.since("created_at", "2001-06-01 00:00:00"),
        "complex_criteria": query.equal(hotel_id=1317) & query.at_least("rating", 5.0) & query.time_between(
            "review_date", "1995-01-01 00:00:00", "2001-12-31 00:00:00"),
    }, ["id"])


@register("exists_external", with_ctes(["reviews"], """
SELECT k.hotel_review_id FROM (SELECT DISTINCT CAST(l_orderkey * 10 + 1 AS VARCHAR) AS hotel_review_id FROM lineitem) k
WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.hotel_review_id = k.hotel_review_id AND r.platform = 'AGODA')"""))
def q_exists_external(spark, sf):
    keys = TD.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + 1).cast("string").alias("hotel_review_id")).distinct()
    r = TD.reviews(spark, sf).filter(F.col("platform") == "AGODA")
    return query.exists_keys(r, keys, ["hotel_review_id"])


@register("review_row_functions", with_ctes(["reviews"], f"""
SELECT id,
  CASE WHEN rating >= 7.0 THEN 'positive' WHEN rating < 5.0 THEN 'negative' WHEN rating IS NOT NULL THEN 'neutral' END AS sentiment,
  coalesce(date_sub('day', review_date, TIMESTAMP '{AS_OF}'), 0) AS age_days,
  coalesce(date_sub('day', review_date, TIMESTAMP '{AS_OF}'), 0) <= 30 AS is_recent,
  coalesce(review_comments IS NOT NULL AND {jtrim('review_comments')} <> '', false) AS has_text,
  coalesce(review_title IS NOT NULL AND {jtrim('review_title')} <> '', false) AS has_title,
  CASE platform WHEN 'AGODA' THEN 'Agoda' WHEN 'BOOKING' THEN 'Booking' WHEN 'EXPEDIA' THEN 'Expedia' WHEN 'AIRBNB' THEN 'Airbnb' END
    || ':' || hotel_review_id AS business_key,
  coalesce(reviewer_review_count > 5, false) AS experienced_reviewer
FROM reviews"""))
def q_review_row_functions(spark, sf):
    r = TD.reviews(spark, sf)
    now = F.lit(AS_OF).cast("timestamp_ntz")
    return r.select(
        "id", R.sentiment("rating").alias("sentiment"),
        R.review_age_days("review_date", now).alias("age_days"),
        R.is_recent("review_date", now).alias("is_recent"),
        has_text("review_comments").alias("has_text"),
        R.has_title("review_title").alias("has_title"),
        R.business_key(provider_display("platform"), "hotel_review_id").alias("business_key"),
        R.experienced_reviewer("reviewer_review_count").alias("experienced_reviewer"))


@register("review_response", _with_providers("""
SELECT r.id, r.hotel_id, r.hotel_name, p.code AS platform, r.rating, r.rating_text_label AS rating_text, r.review_title,
       r.review_comments, r.review_date, r.reviewer_country_name AS reviewer_country, r.room_type_name, r.length_of_stay,
       r.reviewer_display_name, r.review_negatives, r.review_positives
FROM reviews r LEFT JOIN providers p ON r.platform = p.code WHERE r.rating >= 9.0"""))
def q_review_response(spark, sf):
    from ..operators.transform import review_response
    r = TD.reviews(spark, sf).filter(F.col("rating") >= 9.0)
    return review_response(r, _providers(spark, sf))


@register("review_status", with_ctes(["reviews"], f"""
SELECT id, processing_status, processing_status = 'PROCESSED' AS is_processed, transformed_valid FROM (
  SELECT id, CASE WHEN hotel_id IS NULL OR platform IS NULL OR hotel_review_id IS NULL OR rating IS NULL OR rating < 0 OR rating > 10
                    OR review_date IS NULL OR review_date > TIMESTAMP '{AS_OF}' THEN 'FAILED' ELSE 'PROCESSED' END AS processing_status,
         hotel_id IS NOT NULL AND platform IS NOT NULL AND hotel_review_id IS NOT NULL AS transformed_valid
  FROM reviews)"""))
def q_review_status(spark, sf):
    from ..operators import transform
    v = validate.entity_constraints(TD.reviews(spark, sf), AS_OF)
    v = v.withColumn("processing_status", transform.review_status(F.size("errors") > 0))
    return v.select("id", "processing_status", transform.is_processed(F.col("processing_status")).alias("is_processed"),
                    transform.transformed_valid().alias("transformed_valid"))


# ----------------------------------------------------------------------------
# Hash functions over free-text reviews (documents)
# ----------------------------------------------------------------------------

def _java_hash_sql(x: str) -> str:
    folded = (f"list_reduce(list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT)), "
              f"lambda a, b: (a * 31 + b) % 4294967296, CAST(0 AS BIGINT))")
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = '' THEN '0' ELSE CAST(CASE WHEN {folded} >= 2147483648 "
            f"THEN {folded} - 4294967296 ELSE {folded} END AS VARCHAR) END")


@register("hash_functions", with_ctes(["texts"], f"""
SELECT id, sha256(review_comments) AS sha256_hex, to_base64(unhex(sha256(review_comments))) AS sha256_b64,
       md5(review_comments) AS md5_hex, sha1(review_comments) AS sha1_hex,
       {_java_hash_sql('review_comments')} AS simple_hash, substr(sha256(review_comments), 1, 16) AS short_hash,
       sha256(CAST(hotel_id AS VARCHAR) || '|' || {norm_text('review_comments')} || '|' || CAST(rating AS VARCHAR)) AS review_content_hash,
       sha256(coalesce(hotel_name, '') || '|' || coalesce(translate_source, '')) AS combined_hash,
       coalesce(md5(review_comments) = md5(hotel_name), false) AS verify_md5,
       coalesce(md5(review_comments) = md5(review_comments), false) AS verify_own_md5,
       coalesce(regexp_full_match(hotel_name, '[a-fA-F0-9]+'), false) AS valid_name,
       coalesce(regexp_full_match(sha256(review_comments), '[a-fA-F0-9]+') AND length(sha256(review_comments)) = 64, false) AS valid_sha256
FROM review_texts"""))
def q_hash_functions(spark, sf):
    t = TD.review_texts(spark, sf)
    c = F.col("review_comments")
    return t.select(
        "id", H.sha256_hex(c).alias("sha256_hex"), H.sha256_b64(c).alias("sha256_b64"),
        H.md5_hex(c).alias("md5_hex"), H.sha1_hex(c).alias("sha1_hex"),
        H.java_string_hash(c).alias("simple_hash"), H.short_hash(c).alias("short_hash"),
        H.review_content_hash(c, "hotel_id", "rating").alias("review_content_hash"),
        H.combined_hash("hotel_name", "translate_source").alias("combined_hash"),
        H.verify_hash(c, F.md5("hotel_name"), F.lit("md5")).alias("verify_md5"),
        H.verify_hash(c, F.md5(c), F.lit("md5")).alias("verify_own_md5"),
        H.valid_hash("hotel_name").alias("valid_name"),
        H.valid_hash(H.sha256_hex(c), 64).alias("valid_sha256"))


# ----------------------------------------------------------------------------
# File listing and ledger (S, L, A11-A14, A18-A19, W2, V13)
# ----------------------------------------------------------------------------

LEDGER_AS_OF = TD.LEDGER_AS_OF


def _files(spark, sf):
    """The file listing (key, size, mtime) of the feed folder."""
    return TD.processed_files(spark, sf).select("s3_key", "etag", "file_size", "last_modified_date", "provider")


@register("list_new_files", with_ctes(["ledger"], """
SELECT s3_key, file_size, last_modified_date FROM processed_files
WHERE last_modified_date > TIMESTAMP '2001-01-01 00:00:00' AND file_size > 0
  AND (lower(s3_key) LIKE '%.jl' OR lower(s3_key) LIKE '%.jsonl')
ORDER BY last_modified_date, s3_key"""))
def q_list_new_files(spark, sf):
    from ..sources.files import list_new_files
    return list_new_files(_files(spark, sf), since="2001-01-01 00:00:00").select("s3_key", "file_size",
                                                                                   "last_modified_date")


@register("list_unprocessed", with_ctes(["ledger"], """
SELECT s3_key FROM processed_files f
WHERE NOT EXISTS (SELECT 1 FROM processed_files l WHERE l.s3_key = f.s3_key AND l.processing_status = 'COMPLETED')"""))
def q_list_unprocessed(spark, sf):
    return ledger.filter_unprocessed(_files(spark, sf), TD.processed_events(spark, sf)).select("s3_key")


@register("total_file_size", with_ctes(["ledger"], """
SELECT count(*) AS file_count, CAST(sum(file_size) AS BIGINT) AS total_size FROM processed_files"""))
def q_total_file_size(spark, sf):
    from ..sources.files import total_file_size
    return total_file_size(_files(spark, sf))


@register("file_counts", with_ctes(["ledger"], """
SELECT provider, processing_status, count(*) AS file_count FROM processed_files GROUP BY 1, 2"""))
def q_file_counts(spark, sf):
    return stats.file_counts(TD.processed_events(spark, sf))


@register("completion_counts", with_ctes(["ledger"], """
SELECT count(*) FILTER (WHERE processing_completed_at < TIMESTAMP '2000-01-01 00:00:00') AS completed_before,
       count(*) FILTER (WHERE processing_status = 'FAILED' AND processing_completed_at < TIMESTAMP '2000-01-01 00:00:00') AS status_before,
       count(*) FILTER (WHERE processing_status = 'FAILED' AND processing_completed_at
                          BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '2000-01-01 00:00:00') AS status_between
FROM processed_files"""))
def q_completion_counts(spark, sf):
    return stats.completion_counts(TD.processed_events(spark, sf), "FAILED", "1998-01-01 00:00:00", "2000-01-01 00:00:00")


_RENAMED = "CASE WHEN id % 3 = 0 THEN upper(etag) || '-2' ELSE etag END"


@register("duplicate_files", with_ctes(["ledger"], "SELECT s3_key, etag FROM processed_files WHERE id % 3 <> 0"))
def q_duplicate_files(spark, sf):
    """A third of the listed files has a new version."""
    lf = TD.processed_files(spark, sf)
    return ledger.duplicate_files(lf.withColumn("etag", F.expr(_RENAMED)).select("s3_key", "etag"), lf)


@register("is_processed", with_ctes(["ledger"], """
SELECT s3_key, 'by_key' AS check_name FROM processed_files WHERE processing_status = 'COMPLETED'
UNION ALL SELECT s3_key, 'by_key_and_etag' FROM processed_files WHERE processing_status = 'COMPLETED' AND id % 3 <> 0"""))
def q_is_processed(spark, sf):
    lf = TD.processed_files(spark, sf)
    listed = lf.withColumn("etag", F.expr(_RENAMED)).select("s3_key", "etag")
    return ledger.is_processed(listed, lf).select("s3_key", F.lit("by_key").alias("check_name")).unionByName(
        ledger.is_processed(listed, lf, with_etag=True).select("s3_key", F.lit("by_key_and_etag").alias("check_name")))


@register("file_finders", with_ctes(["ledger"], "").rstrip() + """,
current AS (SELECT s3_key, provider, created_at, processing_status FROM processed_files WHERE id % 5 <> 0
                 UNION ALL SELECT s3_key, provider, created_at, 'SKIPPED' FROM processed_files WHERE id % 5 = 0)
SELECT s3_key, processing_status, 'by_status' AS finder FROM current WHERE processing_status = 'SKIPPED'
UNION ALL SELECT s3_key, processing_status, 'by_provider_and_status' FROM current WHERE provider = 'Agoda' AND processing_status = 'FAILED'
UNION ALL SELECT s3_key, processing_status, 'created_after' FROM current WHERE created_at >= TIMESTAMP '2001-06-01 00:00:00'
UNION ALL SELECT s3_key, processing_status, 'by_key' FROM current WHERE s3_key = (SELECT max(s3_key) FROM processed_files)""")
def q_file_finders(spark, sf):
    """L7 and L8 over a log in which every fifth file has a second event."""
    lf = TD.processed_files(spark, sf)
    again = lf.filter("id % 5 = 0").withColumns({
        "processing_status": F.lit("SKIPPED"), "id": F.col("id") + 1, "updated_at": F.expr("updated_at + interval 1 hour")})
    last = lf.agg(F.max("s3_key")).first()[0]
    return query.matches(ledger.current_state(lf.unionByName(again)), {
        "by_status": query.equal(processing_status="SKIPPED"),
        "by_provider_and_status": query.equal(provider="Agoda", processing_status="FAILED"),
        "created_after": query.since("created_at", "2001-06-01 00:00:00"),
        "by_key": query.equal(s3_key=last),
    }, ["s3_key", "processing_status"])


@register("file_statistics", with_ctes(["ledger"], """
SELECT provider, count(*) AS total_files,
       count(*) FILTER (WHERE processing_status = 'PENDING') AS pending_files,
       count(*) FILTER (WHERE processing_status = 'IN_PROGRESS') AS processing_files,
       count(*) FILTER (WHERE processing_status = 'COMPLETED') AS completed_files,
       count(*) FILTER (WHERE processing_status = 'FAILED') AS failed_files,
       round(count(*) FILTER (WHERE processing_status = 'COMPLETED') * 100.0 / count(*), 6) AS success_rate,
       round(count(*) FILTER (WHERE processing_status = 'FAILED') * 100.0 / count(*), 6) AS failure_rate
FROM processed_files GROUP BY provider"""))
def q_file_statistics(spark, sf):
    return stats.file_statistics(TD.processed_events(spark, sf))


_DAY = LEDGER_AS_OF[:10]


@register("files_today", with_ctes(["ledger"], f"""
SELECT count(*) FILTER (WHERE processing_completed_at BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:59'
                          AND processing_status = 'COMPLETED') AS processed_today,
       count(*) FILTER (WHERE processing_completed_at BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:59'
                          AND processing_status = 'FAILED') AS failed_today,
       count(*) FILTER (WHERE processing_status = 'COMPLETED') AS total_processed
FROM processed_files"""))
def q_files_today(spark, sf):
    return stats.files_today(TD.processed_events(spark, sf), LEDGER_AS_OF)


@register("stuck_files_reset", with_ctes(["ledger"], f"""
SELECT id + 1 AS id, s3_key, 'FAILED' AS processing_status, '{K.STUCK_MESSAGE}' AS error_message
FROM processed_files WHERE processing_status = 'IN_PROGRESS'
  AND processing_started_at < TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 2 HOUR"""))
def q_stuck_files_reset(spark, sf):
    return ledger.reset_stuck(TD.processed_events(spark, sf), LEDGER_AS_OF).select(
        "id", "s3_key", "processing_status", "error_message")


@register("old_files", with_ctes(["ledger"], """
SELECT id, s3_key, created_at FROM processed_files
WHERE created_at < TIMESTAMP '1995-06-01 00:00:00' AND processing_status IN ('COMPLETED', 'FAILED')"""))
def q_old_files(spark, sf):
    return ledger.old_files(TD.processed_events(spark, sf), "1995-06-01 00:00:00", ["COMPLETED", "FAILED"]) \
        .select("id", "s3_key", "created_at")


@register("recent_files", with_ctes(["ledger"], f"""
SELECT id, s3_key FROM processed_files WHERE provider = 'Agoda' AND processing_status = 'COMPLETED'
  AND created_at >= TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 720 HOUR"""))
def q_recent_files(spark, sf):
    return ledger.recent_files(TD.processed_events(spark, sf), "Agoda", LEDGER_AS_OF, 720).select("id", "s3_key")


@register("ledger_cleanup", with_ctes(["ledger"], f"""
SELECT 'by_created' AS rule, processing_status, count(*) AS files, 3 * count(*) AS events FROM processed_files
WHERE NOT coalesce(created_at < TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 30 DAY
                   AND processing_status IN ('COMPLETED', 'FAILED', 'SKIPPED'), false) GROUP BY ALL
UNION ALL
SELECT 'by_completed', processing_status, count(*), 3 * count(*) FROM processed_files
WHERE NOT coalesce(processing_completed_at < TIMESTAMP '1997-01-01 00:00:00', false) GROUP BY ALL"""))
def q_ledger_cleanup(spark, sf):
    """What a purge leaves: files by the state they are in after it, and all of their events."""
    lf = TD.processed_events(spark, sf)

    def left(rule, kept):
        events = kept.groupBy("s3_key", "etag").agg(F.count(F.lit(1)).alias("events"))
        return (ledger.state_columns(kept, "processing_status").join(events, ["s3_key", "etag"])
                .groupBy(F.lit(rule).alias("rule"), "processing_status")
                .agg(F.count(F.lit(1)).alias("files"), F.sum("events").alias("events")))

    return left("by_created", ledger.cleanup_by_created(lf, LEDGER_AS_OF)).unionByName(
        left("by_completed", ledger.cleanup_by_completed(lf, "1997-01-01 00:00:00")))


@register("ledger_current", with_ctes(["ledger"], f"""
SELECT s3_key, etag,
       CASE WHEN processing_status = 'IN_PROGRESS' AND processing_started_at < TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 2 HOUR
            THEN 'FAILED' ELSE processing_status END AS processing_status,
       CASE WHEN processing_status = 'IN_PROGRESS' AND processing_started_at < TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 2 HOUR
            THEN '{K.STUCK_MESSAGE}' ELSE error_message END AS error_message
FROM processed_files"""))
def q_ledger_current(spark, sf):
    lf = TD.processed_events(spark, sf)
    events = lf.unionByName(ledger.reset_stuck(lf, LEDGER_AS_OF))
    return ledger.current_state(events).select("s3_key", "etag", "processing_status", "error_message")


#: Faults put into ledger rows, and some rows twice, so that the rules of V13 have something to find.
_FAULTY = {
    "etag": "CASE WHEN id % 101 = 0 THEN repeat('x', 300) WHEN id % 103 = 0 THEN ' ' ELSE etag END",
    "file_size": "CASE WHEN id % 107 = 0 THEN 0 ELSE file_size END",
    "processing_status": "CASE WHEN id % 109 = 0 THEN 'LOST' ELSE processing_status END",
    "records_failed": "CASE WHEN id % 113 = 0 THEN -1 ELSE records_failed END",
}


@register("ledger_constraints", with_ctes(["ledger"], """
SELECT s3_key, array_to_string(list_filter([
    CASE WHEN trim(etag) = '' THEN 'etag is required' END,
    CASE WHEN length(etag) > 255 THEN 'etag exceeds 255 characters' END,
    CASE WHEN file_size <= 0 THEN 'file_size must be positive' END,
    CASE WHEN processing_status = 'LOST' THEN 'processing_status is invalid' END,
    CASE WHEN records_failed < 0 THEN 'record counts must be >= 0' END,
    CASE WHEN count(*) OVER (PARTITION BY s3_key, etag) > 1 THEN 'duplicate (s3_key, etag)' END
  ], lambda x: x IS NOT NULL), '; ') AS errors
FROM (SELECT s3_key, """ + ", ".join(f"{v} AS {k}" for k, v in _FAULTY.items()) + """
      FROM (SELECT * FROM processed_files UNION ALL SELECT * FROM processed_files WHERE id % 127 = 0))
QUALIFY errors <> ''"""))
def q_ledger_constraints(spark, sf):
    lf = TD.processed_files(spark, sf)
    lf = lf.unionByName(lf.filter("id % 127 = 0")).withColumns({k: F.expr(v) for k, v in _FAULTY.items()})
    v = validate.ledger_constraints(lf)
    return v.filter(F.size("errors") > 0).select("s3_key", F.array_join("errors", "; ").alias("errors"))


@register("processing_health", with_ctes(["ledger"], f"""
SELECT recent_completed, recent_failed, round(failure_rate * 100, 2) AS failure_rate_pct, last_completed_at,
       stale_hours,
       array_to_string(list_filter([i1, i2], lambda x: x IS NOT NULL), '; ') AS issues,
       CASE WHEN i1 IS NULL AND i2 IS NULL THEN 'UP'
            WHEN (i1 IS NULL OR i2 IS NULL) AND failure_rate <= 0.2 THEN 'DEGRADED' ELSE 'DOWN' END AS health
FROM (SELECT *,
        CASE WHEN failure_rate > 0.1 THEN 'Failure rate (' || CAST(floor(failure_rate * 10000 + 0.5)::DOUBLE / 100 AS VARCHAR)
               || '%) exceeds threshold (10.0%)' END AS i1,
        CASE WHEN stale_hours IS NULL THEN 'No processing history available'
             WHEN stale_hours > 24 THEN 'Processing system is stale - last activity ' || CAST(stale_hours AS VARCHAR) || ' hours ago' END AS i2
FROM (SELECT *, CASE WHEN recent_completed + recent_failed > 0
                     THEN recent_failed / (recent_completed + recent_failed) ELSE 0.0 END AS failure_rate,
             date_sub('hour', last_completed_at, TIMESTAMP '{LEDGER_AS_OF}') AS stale_hours
      FROM (SELECT count(*) FILTER (WHERE processing_completed_at >= TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 24 HOUR
                                     AND processing_status = 'COMPLETED') AS recent_completed,
                   count(*) FILTER (WHERE processing_completed_at >= TIMESTAMP '{LEDGER_AS_OF}' - INTERVAL 24 HOUR
                                     AND processing_status = 'FAILED') AS recent_failed,
                   max(CASE WHEN processing_status = 'COMPLETED' THEN processing_completed_at END) AS last_completed_at
            FROM processed_files)))"""))
def q_processing_health(spark, sf):
    return stats.processing_health(TD.processed_events(spark, sf), LEDGER_AS_OF)


# ----------------------------------------------------------------------------
# Jobs (A15-A17, L15-L19, L23) and metrics
# ----------------------------------------------------------------------------

JOB_AS_OF = TD.JOB_AS_OF


@register("job_statistics", with_ctes(["jobs"], """
SELECT count(*) FILTER (WHERE status = 'COMPLETED') AS completed_jobs,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_jobs,
       count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress_jobs,
       count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_jobs,
       CAST(coalesce(sum(total_reviews), 0) AS BIGINT) AS total_reviews
FROM processing_jobs WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'"""))
def q_job_statistics(spark, sf):
    return stats.job_statistics(TD.processing_jobs(spark, sf), "2024-01-15 00:00:00")


@register("provider_status", with_ctes(["jobs"], f"""
SELECT e.code AS provider, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed,
       coalesce(in_progress, 0) AS in_progress, coalesce(total_reviews, 0) AS total_reviews,
       CASE WHEN coalesce(failed, 0) > 0 AND coalesce(completed, 0) = 0 THEN 'DOWN'
            WHEN coalesce(failed, 0) > coalesce(completed, 0) THEN 'DEGRADED' ELSE 'UP' END AS health,
       last_end_time, last_status
FROM (VALUES {", ".join(f"('{c}')" for c, _ in K.PROVIDER_TYPES)}) AS e(code)
LEFT JOIN (SELECT provider, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
                  count(*) FILTER (WHERE status = 'FAILED') AS failed,
                  count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress,
                  CAST(coalesce(sum(total_reviews), 0) AS BIGINT) AS total_reviews,
                  max(end_time) AS last_end_time, arg_max(status, end_time) AS last_status
           FROM processing_jobs WHERE created_at >= TIMESTAMP '{JOB_AS_OF}' - INTERVAL 24 HOUR GROUP BY provider) j
  ON e.code = j.provider"""))
def q_provider_status(spark, sf):
    return stats.provider_status(TD.processing_jobs(spark, sf), P.provider_enum(spark), JOB_AS_OF)


@register("job_status", with_ctes(["jobs"], f"""
SELECT processing_id, status, provider, start_time, end_time, total_files, processed_files, failed_files,
       total_reviews, error_message,
       CAST(CASE WHEN start_time IS NOT NULL THEN date_sub('millisecond', start_time, coalesce(end_time, TIMESTAMP '{JOB_AS_OF}')) END AS DOUBLE) AS duration_ms,
       round(CASE WHEN total_files IS NULL OR total_files = 0 THEN 0.0
                  ELSE (coalesce(processed_files, 0) + coalesce(failed_files, 0)) * 100.0 / total_files END, 6) AS progress_pct
FROM processing_jobs"""))
def q_job_status(spark, sf):
    return ledger.job_status(TD.processing_jobs(spark, sf), JOB_AS_OF)


@register("job_history", with_ctes(["jobs"], f"""
SELECT processing_id, status, created_at FROM processing_jobs
WHERE provider = 'AGODA' AND created_at BETWEEN TIMESTAMP '{JOB_AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{JOB_AS_OF}'
ORDER BY created_at DESC, processing_id"""))
def q_job_history(spark, sf):
    return ledger.job_history(TD.processing_jobs(spark, sf), JOB_AS_OF, provider="AGODA").select(
        "processing_id", "status", "created_at")


@register("jobs_by_status", with_ctes(["jobs"], """
SELECT processing_id, status, provider FROM processing_jobs
WHERE status IN ('FAILED', 'CANCELLED') AND provider IN ('AGODA', 'BOOKING')"""))
def q_jobs_by_status(spark, sf):
    return ledger.jobs_by_status(TD.processing_jobs(spark, sf), ["FAILED", "CANCELLED"], ["AGODA", "BOOKING"]) \
        .select("processing_id", "status", "provider")


@register("retryable_jobs", with_ctes(["jobs"], """
SELECT processing_id, end_time FROM processing_jobs WHERE status = 'FAILED' AND end_time IS NOT NULL"""))
def q_retryable_jobs(spark, sf):
    return ledger.retryable_jobs(TD.processing_jobs(spark, sf)).select("processing_id", "end_time")


@register("jobs_older_than", with_ctes(["jobs"], """
SELECT count(*) AS purged FROM processing_jobs WHERE created_at < TIMESTAMP '2024-01-10 00:00:00'"""))
def q_jobs_older_than(spark, sf):
    return ledger.jobs_older_than(TD.processing_jobs(spark, sf), "2024-01-10 00:00:00").agg(
        F.count(F.lit(1)).alias("purged"))


@register("job_log_lines", with_ctes(["jobs"], """
SELECT processing_id, CAST(i - 1 AS INTEGER) AS log_pos, lines[i] AS log_line
FROM (SELECT processing_id, list_filter([
        '[' || strftime(created_at, '%Y-%m-%dT%H:%M') || CASE WHEN strftime(created_at, '%f') <> '000000' THEN strftime(created_at, ':%S.') || regexp_replace(strftime(created_at, '%f'), '000$', '')
          WHEN second(created_at) <> 0 THEN strftime(created_at, ':%S') ELSE '' END || '] Processing job created: ' || processing_id,
        CASE WHEN start_time IS NOT NULL THEN '[' || strftime(start_time, '%Y-%m-%dT%H:%M') || CASE WHEN strftime(start_time, '%f') <> '000000' THEN strftime(start_time, ':%S.') || regexp_replace(strftime(start_time, '%f'), '000$', '')
          WHEN second(start_time) <> 0 THEN strftime(start_time, ':%S') ELSE '' END || '] Processing started' END,
        CASE WHEN processed_files > 0 THEN 'Processed ' || CAST(processed_files AS VARCHAR) || ' files successfully' END,
        CASE WHEN failed_files > 0 THEN 'Failed to process ' || CAST(failed_files AS VARCHAR) || ' files' END,
        CASE WHEN end_time IS NOT NULL THEN '[' || strftime(end_time, '%Y-%m-%dT%H:%M') || CASE WHEN strftime(end_time, '%f') <> '000000' THEN strftime(end_time, ':%S.') || regexp_replace(strftime(end_time, '%f'), '000$', '')
          WHEN second(end_time) <> 0 THEN strftime(end_time, ':%S') ELSE '' END || '] Processing completed with status: ' || status END,
        CASE WHEN error_message IS NOT NULL THEN 'Error: ' || error_message END], lambda x: x IS NOT NULL) AS lines
      FROM processing_jobs), unnest(range(1, len(lines) + 1)) AS r(i)"""))
def q_job_log_lines(spark, sf):
    return ledger.job_log_lines(TD.processing_jobs(spark, sf))


@register("metric_counters", with_ctes(["metrics"], """
SELECT metric, provider, status, count(*) AS observations, round(sum(value), 6) AS total
FROM metrics GROUP BY 1, 2, 3"""))
def q_metric_counters(spark, sf):
    return stats.metric_counters(TD.metrics(spark, sf))


@register("metric_gauges", with_ctes(["metrics"], """
SELECT metric, provider, CAST(trunc(arg_max(value, ts)) AS BIGINT) AS last_value, max(ts) AS last_ts
FROM metrics GROUP BY 1, 2"""))
def q_metric_gauges(spark, sf):
    return stats.metric_gauges(TD.metrics(spark, sf))


def _rank_sql(p: float) -> str:
    return f"values_[CAST(ceil({p} * len(values_)) AS BIGINT)]"


@register("metric_timers", with_ctes(["metrics"], f"""
SELECT metric, provider, len(values_) AS count, round(list_sum(values_), 6) AS total_ms, values_[-1] AS max_ms,
       {_rank_sql(0.5)} AS p50_ms, {_rank_sql(0.95)} AS p95_ms, {_rank_sql(0.99)} AS p99_ms,
       {", ".join(f"len(list_filter(values_, lambda x: x <= {b})) AS le_{b}ms" for b in K.SLO_BUCKETS_MS)}
FROM (SELECT metric, provider, list(value ORDER BY value) AS values_ FROM metrics GROUP BY 1, 2)"""))
def q_metric_timers(spark, sf):
    return stats.metric_timers(TD.metrics(spark, sf))


def queries() -> dict[str, Builder]:
    return {q.key: q.build for q in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {q.key: q.sql for q in REGISTRY if q.sql is not None}


# ----------------------------------------------------------------------------
# Constraints, JSON maps, dates, ledger events, job transitions, metrics rows
# ----------------------------------------------------------------------------

def _len_rule(col: str, limit: int) -> str:
    return f"CASE WHEN length({col}) > {limit} THEN '{col} exceeds {limit} characters' END"


_REVIEW_COLS = ["hotel_name", "hotel_review_id", "review_comments", "review_title", "translate_source", "content_hash"]


@register("entity_constraints", with_ctes(["reviews"], f"""
SELECT id, array_to_string(errs, '; ') AS errors FROM (
  SELECT id, list_filter([
    CASE WHEN hotel_id IS NULL THEN 'hotel_id is required' END,
    CASE WHEN platform IS NULL OR {jtrim('platform')} = '' THEN 'platform is required' END,
    CASE WHEN hotel_review_id IS NULL OR {jtrim('hotel_review_id')} = '' THEN 'hotel_review_id is required' END,
    CASE WHEN rating IS NULL THEN 'rating is required' END,
    CASE WHEN rating < 0 OR rating > 10 THEN 'rating must be between 0 and 10' END,
    CASE WHEN review_date IS NULL THEN 'review_date is required' END,
    CASE WHEN review_date > TIMESTAMP '{AS_OF}' THEN 'review_date must not be in the future' END,
    CASE WHEN length_of_stay < 0 THEN 'length_of_stay must be >= 0' END,
    CASE WHEN reviewer_review_count < 0 THEN 'reviewer_review_count must be >= 0' END,
    {", ".join(_len_rule(c, n) for c, n in K.REVIEW_MAX_LENGTHS if c in _REVIEW_COLS)}
  ], lambda x: x IS NOT NULL) AS errs FROM reviews) WHERE len(errs) > 0"""))
def q_entity_constraints(spark, sf):
    v = validate.entity_constraints(TD.reviews(spark, sf), AS_OF)
    return v.filter(F.size("errors") > 0).select("id", F.array_join("errors", "; ").alias("errors"))


@register("referential_check", _with_providers("""
SELECT 'orphan_reviews' AS check_name, count(*) AS value FROM reviews r
WHERE NOT EXISTS (SELECT 1 FROM providers p WHERE p.code = r.platform)
UNION ALL
SELECT 'providers_in_use', count(*) FROM providers p WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.platform = p.code)"""))
def q_referential_check(spark, sf):
    """Reviews are counted by platform first, so only a row for each platform meets the providers."""
    per = TD.reviews(spark, sf).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    codes = _providers(spark, sf).select(F.col("code").alias("platform"), F.lit(True).alias("known"))
    one = per.join(codes, "platform", "left").agg(
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_reviews"),
        F.count_if("known").alias("providers_in_use"))
    return stats.as_rows(one, "check_name")


@register("comment_keys", with_ctes(["parsed"], """
SELECT key, count(*) AS occurrences FROM (
  SELECT unnest(json_keys(json_extract(j, '$.comment'))) AS key FROM parsed
  WHERE j IS NOT NULL AND json_type(json_extract(j, '$.comment')) = 'OBJECT') GROUP BY key"""))
def q_comment_keys(spark, sf):
    m = parse.comment_map(parse.parse_lines(TD.review_lines(spark, sf)))
    return (m.select(F.explode(F.map_keys("comment_map")).alias("key"))
            .groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")))


_TDATE = (r"'^(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?((Z|[+-]\d{2}:\d{2}(:\d{2})?)"
          r"(\[[^\]]+\])?)?|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})$'")
_LOCALP = r"'^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?)'"


@register("parse_dates", with_ctes(["parsed"], f"""
SELECT file_key, line_no, date_text,
  CASE WHEN regexp_full_match(date_text, {_TDATE}) THEN TRY_CAST(regexp_extract(date_text, {_LOCALP}, 1) AS TIMESTAMP) END
    AS transform_date
FROM parsed WHERE date_text IS NOT NULL"""))
def q_parse_dates(spark, sf):
    from ..functions.dates import parse_review_date
    # Written before the filter: Spark would push it below the parse, and a filter parses a line again for each mention.
    texts = staged(parse.parse_lines(TD.review_lines(spark, sf)).select("file_key", "line_no", "date_text"), "dates")
    p = texts.filter(F.col("date_text").isNotNull())
    return p.select("file_key", "line_no", "date_text",
                    parse_review_date("date_text", validator=False).alias("transform_date"))


@register("track_files", with_ctes(["ledger"], f"""
SELECT s3_key, CASE WHEN old THEN 3 ELSE 1 END AS events,
       CASE WHEN old THEN updated_at ELSE TIMESTAMP '{LEDGER_AS_OF}' END AS updated_at,
       CASE WHEN old THEN processing_status ELSE 'PENDING' END AS processing_status
FROM (SELECT *, created_at < TIMESTAMP '1997-01-01 00:00:00' AS old FROM processed_files)"""))
def q_track_files(spark, sf):
    """L3: the events of new files appended to a log that knows the older ones; then the state of all files."""
    known = TD.processed_events(spark, sf).filter(F.col("created_at") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    log = known.unionByName(ledger.track_files(_files(spark, sf), known, LEDGER_AS_OF))
    events = log.groupBy("s3_key").agg(F.count(F.lit(1)).alias("events"))
    return ledger.state_columns(log, "processing_status").join(events, "s3_key").select(
        "s3_key", "events", "updated_at", "processing_status")


@register("select_job_files", with_ctes(["ledger"], """
SELECT s3_key, last_modified_date FROM processed_files f
WHERE NOT EXISTS (SELECT 1 FROM processed_files l WHERE l.s3_key = f.s3_key AND l.processing_status = 'COMPLETED')
ORDER BY last_modified_date, s3_key LIMIT 100"""))
def q_select_job_files(spark, sf):
    return ledger.select_job_files(_files(spark, sf), TD.processed_files(spark, sf), None, 100) \
        .select("s3_key", "last_modified_date")


@register("job_transitions", with_ctes(["jobs"], """
SELECT processing_id, event_ts, seq, status, previous_status,
       previous_status IS NULL OR (previous_status = 'PENDING' AND status IN ('IN_PROGRESS', 'CANCELLED', 'FAILED'))
         OR (previous_status = 'IN_PROGRESS' AND status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS legal
FROM (SELECT *, lag(status) OVER (PARTITION BY processing_id ORDER BY event_ts, seq) AS previous_status
      FROM (SELECT processing_id, created_at AS event_ts, 0 AS seq, 'PENDING' AS status FROM processing_jobs
            UNION ALL SELECT processing_id, start_time, 1, 'IN_PROGRESS' FROM processing_jobs WHERE start_time IS NOT NULL
            UNION ALL SELECT processing_id, end_time, 2, status FROM processing_jobs WHERE end_time IS NOT NULL))"""))
def q_job_transitions(spark, sf):
    ev = ledger.job_events(TD.processing_jobs(spark, sf))
    return job_log.job_transitions(ev).select("processing_id", "event_ts", "seq", "status", "previous_status", "legal")


@register("job_state", with_ctes(["job_log"], """,
paths AS (
  SELECT processing_id, count(*) AS events, count(status) AS moves,
         list_reduce(list_prepend('', coalesce(list(status || '@' || CAST(epoch_us(event_ts) AS VARCHAR) ORDER BY event_ts, seq)
                                               FILTER (WHERE status IS NOT NULL), [])), lambda p, e:
           CASE WHEN p = ''
                  OR (regexp_matches(p, 'PENDING@[0-9]+$') AND split_part(e, '@', 1) IN ('IN_PROGRESS', 'CANCELLED', 'FAILED'))
                  OR (regexp_matches(p, 'IN_PROGRESS@[0-9]+$') AND split_part(e, '@', 1) IN ('COMPLETED', 'FAILED', 'CANCELLED'))
                THEN p || '>' || e ELSE p END) AS path,
         last(processed_files ORDER BY event_ts, seq) FILTER (WHERE processed_files IS NOT NULL) AS processed_files,
         last(failed_files ORDER BY event_ts, seq) FILTER (WHERE processed_files IS NOT NULL) AS failed_files,
         last(total_reviews ORDER BY event_ts, seq) FILTER (WHERE processed_files IS NOT NULL) AS total_reviews,
         count(*) FILTER (WHERE file_list = 'processed') AS added_processed,
         count(*) FILTER (WHERE file_list = 'failed') AS added_failed
  FROM job_log GROUP BY processing_id)
SELECT processing_id, nullif(regexp_extract(path, '([A-Z_]+)@[0-9]+$', 1), '') AS status, events,
       moves - (length(path) - length(replace(path, '>', ''))) AS refused_moves,
       make_timestamp(CAST(nullif(regexp_extract(path, 'IN_PROGRESS@([0-9]+)', 1), '') AS BIGINT)) AS start_time,
       make_timestamp(CAST(nullif(regexp_extract(path, '(COMPLETED|FAILED|CANCELLED)@([0-9]+)$', 2), '') AS BIGINT)) AS end_time,
       coalesce(processed_files, -1) AS processed_files, coalesce(failed_files, -1) AS failed_files,
       coalesce(total_reviews, -1) AS total_reviews, added_processed, added_failed
FROM paths""".replace("WITH ,", "WITH ")))
def q_job_state(spark, sf):
    # a job without a report shows -1, so that the counts stay whole numbers in the comparison
    return job_log.job_state(TD.job_log(spark, sf)).fillna(-1, ["processed_files", "failed_files", "total_reviews"])


@register("job_log_transitions", with_ctes(["job_log"], """
SELECT processing_id, event_ts, seq, status, previous_status,
       previous_status IS NULL OR (previous_status = 'PENDING' AND status IN ('IN_PROGRESS', 'CANCELLED', 'FAILED'))
         OR (previous_status = 'IN_PROGRESS' AND status IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS legal
FROM (SELECT *, lag(status) OVER (PARTITION BY processing_id ORDER BY event_ts, seq) AS previous_status
      FROM job_log WHERE status IS NOT NULL)"""))
def q_job_log_transitions(spark, sf):
    moves = TD.job_log(spark, sf).select("processing_id", "event_ts", "seq", "status").filter("status is not null")
    return job_log.job_transitions(moves)


@register("meter_counters", with_ctes(["meters"], """
SELECT metric, tags, n_tags, count(*) AS observations, CAST(sum(value) AS BIGINT) AS total
FROM (SELECT metric, value, unnest([t1 || ',' || t2 || coalesce(',' || t3, ''), t1, t2, t3, '']) AS tags,
             unnest([CASE WHEN t3 IS NULL THEN 2 ELSE 3 END, 1, 1, 1, 0]) AS n_tags FROM meter_observations)
WHERE tags IS NOT NULL GROUP BY 1, 2, 3"""))
def q_meter_counters(spark, sf):
    return stats.meter_counters(TD.meter_observations(spark, sf))


@register("platform_statistics_merged", with_ctes(["reviews"], """
SELECT platform, count(*) AS review_count, round(avg(rating), 6) AS average_rating,
       min(rating) AS min_rating, max(rating) AS max_rating,
       min(review_date) AS first_review_date, max(review_date) AS last_review_date,
       count(*) FILTER (WHERE rating >= 7.0) AS positive_count,
       count(*) FILTER (WHERE rating >= 5.0 AND rating < 7.0) AS neutral_count,
       count(*) FILTER (WHERE rating < 5.0) AS negative_count
FROM reviews GROUP BY platform"""))
def q_platform_statistics_merged(spark, sf):
    """A store of three batches, two of them with states: one before and one after a compaction."""
    reviews = staged(TD.reviews(spark, sf).select("id", "platform", "hotel_id", "rating", "review_date"), "reviews")
    root = f"{reviews._staged_path}-store"
    for b in range(3):
        tables.write_reviews(reviews.filter(F.pmod("id", F.lit(3)) == b), root, f"b{b}")
        if b == 0:
            tables.compact_reviews(spark, root)
        if b < 2:
            states.write_states(spark, root, states.REVIEWS)
    return states.platform_statistics(spark, root).drop("median_rating")


@register("health_thresholds", with_ctes(["ledger"], f"""
SELECT processed_today, failed_today,
       round(CASE WHEN processed_today + failed_today > 0 THEN processed_today * 100.0 / (processed_today + failed_today)
                  ELSE 100.0 END, 2) AS success_rate,
       CASE WHEN processed_today + failed_today >= 10
                 AND failed_today / (processed_today + failed_today) > 0.1 THEN 'DOWN' ELSE 'UP' END AS health
FROM (SELECT count(*) FILTER (WHERE processing_completed_at BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:59'
                               AND processing_status = 'COMPLETED') AS processed_today,
             count(*) FILTER (WHERE processing_completed_at BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:59'
                               AND processing_status = 'FAILED') AS failed_today FROM processed_files)"""))
def q_health_thresholds(spark, sf):
    return stats.health_thresholds(TD.processed_events(spark, sf), LEDGER_AS_OF)


@register("system_metrics", with_ctes(["reviews", "ledger", "jobs"], f"""
SELECT 'total_reviews' AS metric, CAST(count(*) AS DOUBLE) AS value FROM reviews
UNION ALL SELECT 'reviews_last_24h', CAST(count(*) AS DOUBLE) FROM reviews
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
UNION ALL SELECT 'average_rating', round(avg(rating), 6) FROM reviews
UNION ALL SELECT 'files_processed_today', CAST(count(*) AS DOUBLE) FROM processed_files
  WHERE processing_status = 'COMPLETED' AND processing_completed_at BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:59'
UNION ALL SELECT 'files_failed_today', CAST(count(*) AS DOUBLE) FROM processed_files
  WHERE processing_status = 'FAILED' AND processing_completed_at BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:59'
UNION ALL SELECT 'jobs_completed_24h', CAST(count(*) AS DOUBLE) FROM processing_jobs
  WHERE status = 'COMPLETED' AND created_at >= TIMESTAMP '{JOB_AS_OF}' - INTERVAL 24 HOUR
UNION ALL SELECT 'reviews_from_jobs_24h', CAST(coalesce(sum(total_reviews), 0) AS DOUBLE) FROM processing_jobs
  WHERE created_at >= TIMESTAMP '{JOB_AS_OF}' - INTERVAL 24 HOUR"""))
def q_system_metrics(spark, sf):
    """One aggregate for each of the three tables."""
    from ..functions.dates import shift, ts
    since = shift(ts(JOB_AS_OF), hours=-24)
    recent = F.col("created_at") >= since
    r = TD.reviews(spark, sf).agg(
        F.count(F.lit(1)).cast("double").alias("total_reviews"),
        F.count_if(F.col("created_at") >= shift(ts(AS_OF), hours=-24)).cast("double").alias("reviews_last_24h"),
        F.round(F.avg("rating"), 6).alias("average_rating"))
    f = stats.files_today(TD.processed_events(spark, sf), LEDGER_AS_OF).select(
        F.col("processed_today").cast("double").alias("files_processed_today"),
        F.col("failed_today").cast("double").alias("files_failed_today"))
    j = TD.processing_jobs(spark, sf).agg(
        F.count_if(recent & (F.col("status") == "COMPLETED")).cast("double").alias("jobs_completed_24h"),
        F.coalesce(F.sum(F.when(recent, F.col("total_reviews"))), F.lit(0)).cast("double").alias("reviews_from_jobs_24h"))
    return stats.as_rows(r).unionByName(stats.as_rows(f)).unionByName(stats.as_rows(j))


@register("provider_metrics", _with_providers("""
SELECT p.code AS platform, coalesce(r.review_count, 0) AS review_count, coalesce(r.average_rating, 0.0) AS average_rating,
       coalesce(f.completed_files, 0) AS completed_files, coalesce(f.failed_files, 0) AS failed_files
FROM providers p
LEFT JOIN (SELECT platform, count(*) AS review_count, round(avg(rating), 6) AS average_rating
           FROM reviews GROUP BY platform) r ON p.code = r.platform
LEFT JOIN (SELECT upper(provider) AS platform, count(*) FILTER (WHERE processing_status = 'COMPLETED') AS completed_files,
                  count(*) FILTER (WHERE processing_status = 'FAILED') AS failed_files
           FROM processed_files GROUP BY 1) f ON p.code = f.platform""", ["ledger"]))
def q_provider_metrics(spark, sf):
    return stats.provider_metrics(TD.reviews(spark, sf), TD.processed_events(spark, sf), _providers(spark, sf))


@register("service_totals", _with_providers("""
SELECT 'total_reviews' AS metric, count(*) AS value FROM reviews
UNION ALL SELECT 'total_providers', count(*) FROM providers"""))
def q_service_totals(spark, sf):
    r, p = TD.reviews(spark, sf), _providers(spark, sf)
    a = r.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_reviews").alias("metric"), "value")
    b = p.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_providers").alias("metric"), "value")
    return a.unionByName(b)


@register("ledger_row_functions", with_ctes(["ledger"], f"""
SELECT id,
  CAST(CASE WHEN processing_started_at IS NOT NULL THEN date_sub('millisecond', processing_started_at,
       coalesce(processing_completed_at, TIMESTAMP '{LEDGER_AS_OF}')) END AS DOUBLE) AS duration_ms,
  processing_status IN ('COMPLETED', 'FAILED', 'CANCELLED', 'SKIPPED') AS is_terminal,
  processing_status IN ('PENDING', 'IN_PROGRESS') AS is_active,
  processing_status = 'COMPLETED' AS is_successful, processing_status = 'FAILED' AS is_failed,
  CASE WHEN length(error_message) > 2000 THEN substr(error_message, 1, 2000) ELSE error_message END AS error_message
FROM processed_files"""))
def q_ledger_row_functions(spark, sf):
    from ..functions.dates import ts
    from ..functions.text import truncate
    from ..operators.transform import status_flags
    lf = status_flags(TD.processed_files(spark, sf), "processing_status")
    return lf.select("id", R.duration_ms("processing_started_at", "processing_completed_at", ts(LEDGER_AS_OF))
                     .cast("double").alias("duration_ms"),
                     "is_terminal", "is_active", "is_successful", "is_failed",
                     truncate("error_message", K.LEDGER_ERROR_MAX).alias("error_message"))


@register("latest_records", with_ctes(["ledger", "jobs"], """
SELECT * FROM (SELECT 'latest_job' AS record, processing_id AS record_key FROM processing_jobs
               ORDER BY created_at DESC NULLS LAST, processing_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'latest_file', s3_key FROM processed_files
               ORDER BY processing_completed_at DESC NULLS LAST, s3_key LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'oldest_file', s3_key FROM processed_files
               ORDER BY last_modified_date ASC NULLS LAST, s3_key LIMIT 1)"""))
def q_latest_records(spark, sf):
    j, lf = TD.processing_jobs(spark, sf), TD.processed_files(spark, sf)
    a = query.top_by(j, "created_at", 1, desc=True, tie_break="processing_id").select(
        F.lit("latest_job").alias("record"), F.col("processing_id").alias("record_key"))
    b = query.top_by(lf, "processing_completed_at", 1, desc=True, tie_break="s3_key").select(
        F.lit("latest_file").alias("record"), F.col("s3_key").alias("record_key"))
    c = query.top_by(lf, "last_modified_date", 1, desc=False, tie_break="s3_key").select(
        F.lit("oldest_file").alias("record"), F.col("s3_key").alias("record_key"))
    return a.unionByName(b).unionByName(c)


@register("job_count_status_range", with_ctes(["jobs"], """
SELECT count(*) AS job_count FROM processing_jobs
WHERE status = 'FAILED' AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"""))
def q_job_count_status_range(spark, sf):
    return stats.job_count_status_range(TD.processing_jobs(spark, sf), "FAILED", "2024-01-05 00:00:00",
                                        "2024-01-20 00:00:00")


@register("provider_constraints", _with_providers("""
SELECT name, array_to_string(list_filter([
    CASE WHEN name IS NULL OR trim(name) = '' THEN 'name is required' END,
    CASE WHEN length(name) > 100 THEN 'name exceeds 100 characters' END,
    CASE WHEN api_endpoint IS NOT NULL AND NOT regexp_matches(api_endpoint, '^(https?://)[a-zA-Z0-9.-]+(:[0-9]+)?(/.*)?$') THEN 'api_endpoint must be a valid URL' END,
    CASE WHEN length(api_endpoint) > 255 THEN 'api_endpoint exceeds 255 characters' END,
    CASE WHEN rating_scale < 1 OR rating_scale > 10 THEN 'rating_scale must be between 1 and 10' END,
    CASE WHEN length(supported_languages) > 200 THEN 'supported_languages exceeds 200 characters' END
  ], lambda x: x IS NOT NULL), '; ') AS errors FROM providers"""))
def q_provider_constraints(spark, sf):
    v = validate.provider_constraints(_providers(spark, sf).withColumn("description", F.lit(None).cast("string")))
    return v.select("name", F.array_join("errors", "; ").alias("errors"))


@register("mark_transitions", with_ctes(["ledger"], f"""
SELECT s3_key, 'COMPLETED' AS processing_status, TIMESTAMP '{LEDGER_AS_OF}' AS processing_completed_at,
       CAST(NULL AS VARCHAR) AS error_message FROM processed_files WHERE processing_status = 'IN_PROGRESS'
UNION ALL
SELECT s3_key, 'IN_PROGRESS', processing_completed_at, NULL FROM processed_files WHERE processing_status = 'FAILED'"""))
def q_mark_transitions(spark, sf):
    lf = TD.processed_files(spark, sf)
    done = ledger.mark(lf, lf.filter(F.col("processing_status") == "IN_PROGRESS"), "COMPLETED", LEDGER_AS_OF)
    retry = ledger.mark(lf, lf.filter(F.col("processing_status") == "FAILED"), "IN_PROGRESS", LEDGER_AS_OF)
    cols = ["s3_key", "processing_status", "processing_completed_at", "error_message"]
    return done.select(*cols).unionByName(retry.select(*cols))


_SINCE = "2001-01-01 00:00:00"
_NEW_FILES_SQL = f"""file_key IN (
      SELECT 'reviews/' || o_orderpriority || '/order-' || CAST(o_orderkey AS VARCHAR) || '.jl' FROM orders
      WHERE o_orderdate > TIMESTAMP '{_SINCE}')"""


@register("files_since", with_ctes(["staged"], """
SELECT file_key, count(*) AS total_lines, count(*) FILTER (WHERE outcome = 'valid') AS valid_count,
       count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) AS invalid_count,
       count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate_count
FROM tagged GROUP BY file_key""", lines_filter=_NEW_FILES_SQL))
def q_files_since(spark, sf):
    """List the files modified since t (S3), ingest
    their lines (E2) and report per file."""
    from ..sources.files import list_new_files
    new = list_new_files(_files(spark, sf), since=_SINCE).select(F.col("s3_key").alias("file_key"))
    lines = TD.review_lines(spark, sf).join(new, "file_key", "left_semi")
    r = E.batch_result(E.ingest_batch(lines, AS_OF))
    return r.select("file_key", "total_lines", "valid_count", "invalid_count", "duplicate_count")


@register("job_files_join", with_ctes(["ledger"], """
SELECT provider || '-' || strftime(created_at, '%Y-%m-%d') AS run_id,
       count(*) FILTER (WHERE processing_status = 'COMPLETED') AS processed_file_count,
       count(*) FILTER (WHERE processing_status = 'FAILED') AS failed_file_count,
       min(CASE WHEN processing_status = 'COMPLETED' THEN s3_key END) AS first_processed_file,
       max(CASE WHEN processing_status = 'FAILED' THEN s3_key END) AS last_failed_file
FROM processed_files GROUP BY 1"""))
def q_job_files_join(spark, sf):
    return ledger.job_files_join(ledger.ledger_runs(TD.processed_events(spark, sf)))


@register("job_file_rows", with_ctes(["ledger"], """
SELECT run_id, list, s3_key FROM (
  SELECT DISTINCT provider || '-' || strftime(created_at, '%Y-%m-%d') AS run_id FROM processed_files)
LEFT JOIN (SELECT provider || '-' || strftime(created_at, '%Y-%m-%d') AS run_id, s3_key,
                  CASE processing_status WHEN 'COMPLETED' THEN 'processed' ELSE 'failed' END AS list
           FROM processed_files WHERE processing_status IN ('COMPLETED', 'FAILED')) USING (run_id)"""))
def q_job_file_rows(spark, sf):
    return ledger.job_file_rows(ledger.ledger_runs(TD.processed_events(spark, sf)))


@register("job_summary", with_ctes(["ledger"], """
SELECT *, 'Processing completed for job: ' || run_id || '. Files processed: ' || processed_files || ', Failed: ' || failed_files
          || ', Total reviews: ' || total_reviews AS summary
FROM (SELECT provider || '-' || strftime(created_at, '%Y-%m-%d') AS run_id,
             count(*) FILTER (WHERE processing_status = 'COMPLETED') AS processed_files,
             count(*) FILTER (WHERE processing_status = 'FAILED') AS failed_files,
             CAST(coalesce(sum(records_processed) FILTER (WHERE processing_status = 'COMPLETED'), 0) AS BIGINT) AS total_reviews
      FROM processed_files GROUP BY 1)"""))
def q_job_summary(spark, sf):
    return ledger.job_summary(ledger.ledger_runs(TD.processed_events(spark, sf)))


@register("retry_jobs", with_ctes(["jobs"], f"""
SELECT processing_id || '-retry' AS processing_id, 'PENDING' AS status, provider, true AS is_asynchronous, s3_prefix, max_files,
       'RETRY_' || processing_id AS triggered_by, TIMESTAMP '{JOB_AS_OF}' AS created_at
FROM processing_jobs WHERE status = 'FAILED'"""))
def q_retry_jobs(spark, sf):
    return ledger.retry_jobs(TD.processing_jobs(spark, sf), JOB_AS_OF)


@register("select_all_job_files", with_ctes(["ledger"], """
SELECT s3_key, last_modified_date FROM processed_files
WHERE contains(lower(s3_key), 'urgent') AND processing_status <> 'COMPLETED'"""))
def q_select_all_job_files(spark, sf):
    """L21 without a limit, for the keys that name a feed."""
    return ledger.select_job_files(_files(spark, sf), TD.processed_files(spark, sf), "URGENT") \
        .select("s3_key", "last_modified_date")


@register("replay_failed", with_ctes(["staged"], """
SELECT file_key, count(*) AS total_lines, count(*) FILTER (WHERE outcome = 'valid') AS valid_count,
       count(*) FILTER (WHERE outcome IN ('invalid', 'failed')) AS invalid_count
FROM tagged GROUP BY file_key""", lines_filter="""file_key IN (
      SELECT 'reviews/' || o_orderpriority || '/order-' || CAST(o_orderkey AS VARCHAR) || '.jl' FROM orders
      WHERE o_orderstatus = 'O')"""))
def q_replay_failed(spark, sf):
    # The state of a file is taken as one value, so a column that nothing reads is left out before it.
    events = TD.processed_events(spark, sf).select("id", "s3_key", "etag", "processing_status", "provider", "created_at", "updated_at")
    lines = ledger.replay_failed(ledger.ledger_runs(events), TD.review_lines(spark, sf))
    r = E.batch_result(E.ingest_batch(lines, AS_OF))
    return r.select("file_key", "total_lines", "valid_count", "invalid_count")
