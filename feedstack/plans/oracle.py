"""DuckDB SQL for the correctness gate.

The adapters of ``feedstack.sources.testdata`` and the line pipeline written
as plain SQL over the driver's tables.  Each query's oracle is
``with_ctes(<names>, <select>)``.  Nothing here runs on Spark.
"""

from __future__ import annotations

from ..sources import testdata as TD

_TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$'"


def _case(expr: str, values: list) -> str:
    parts = " ".join(f"WHEN {i} THEN {v!r}" if isinstance(v, str) else f"WHEN {i} THEN {v}"
                     for i, v in enumerate(values))
    return f"CASE ({expr}) {parts} END"


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, {_TRIM}, '', 'g')"


def norm_text(x: str) -> str:
    return f"regexp_replace(lower({jtrim(x)}), '\\s+', ' ', 'g')"


BASE = f"""
base AS (
  SELECT 'reviews/' || o.o_orderpriority || '/order-' || CAST(l.l_orderkey AS VARCHAR) || '.jl' AS file_key,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
             l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate) AS line_no,
         l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, p.p_type, p.p_brand,
         c.c_name, c.c_nationkey, c.c_mktsegment, n.n_name,
         {_case('l.l_suppkey % 4', TD.FEED_NAMES)} AS provider_name,
         {_case('l.l_suppkey % 4', TD.FEED_CODES)} AS platform,
         {_case('l.l_suppkey % 4', TD.FEED_EXTERNAL_IDS)} AS external_id,
         CAST(l.l_suppkey % 4 + 1 AS BIGINT) AS provider_id,
         CAST(CAST(round(l.l_discount * 100) AS INTEGER) AS VARCHAR) || '.' ||
           CAST(CAST(round(l.l_tax * 100) AS INTEGER) AS VARCHAR) AS rating_text,
         l.l_orderkey * 10 + l.l_linenumber AS hrid,
         l.l_shipdate, o.o_orderdate,
         CAST(trunc(l.l_quantity) AS INTEGER) AS stay,
         {_case('c.c_nationkey % 4', TD.LANGS)} AS lang,
         p.p_type || ' room, ' || lower(c.c_mktsegment) || ' trip  ' || p.p_name AS comments,
         (l.l_orderkey * 31 + l.l_linenumber * 7 + l.l_partkey) % 50 AS shape
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

_ISO = "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')"
LINES = f"""
lines0 AS (
  SELECT file_key, line_no,
    '{{"hotelId":' || CASE WHEN shape = 3 THEN '"' || CAST(l_partkey AS VARCHAR) || '"' ELSE CAST(l_partkey AS VARCHAR) END
    || ',' || CASE WHEN shape = 11 THEN '' ELSE '"platform":"' || provider_name || '",' END
    || '"hotelName":"' || CASE WHEN shape = 11 THEN '  ' ELSE p_name END || '","comment":'
    || CASE WHEN shape = 2 THEN '"' || comments || '"' ELSE
         '{{' || CASE WHEN shape = 5 THEN ''
                     WHEN shape = 10 THEN '"hotelReviewId":"' || CAST(hrid AS VARCHAR) || 'x",'
                     WHEN shape = 12 THEN '"hotelReviewId":0,'
                     ELSE '"hotelReviewId":' || CAST(hrid AS VARCHAR) || ',' END
         || '"providerId":' || CAST(external_id AS VARCHAR)
         || ',"rating":' || CASE WHEN shape = 4 THEN '"' || rating_text || '"' ELSE rating_text END
         || ',"reviewDate":"' || CASE WHEN shape = 6 THEN strftime(l_shipdate, '%Y-%m-%d')
                                      WHEN shape = 7 THEN strftime(l_shipdate, '%d/%m/%Y')
                                      WHEN shape = 13 THEN {_ISO} || '+07:00[Asia/Bangkok]'
                                      WHEN l_linenumber % 3 = 0 THEN {_ISO} || '+07:00'
                                      WHEN l_linenumber % 3 = 1 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')
                                      ELSE {_ISO} || '.000Z' END
         || '","reviewTitle":"' || p_brand
         || '","reviewComments":"' || CASE WHEN shape = 8 THEN '   ' ELSE comments END
         || '","translateSource":"' || lang
         || '","reviewerInfo":{{"countryName":"' || CASE WHEN shape = 8 THEN '' ELSE n_name END
         || '","displayMemberName":"' || c_name
         || '","lengthOfStay":' || CASE WHEN shape = 9 THEN '"abc"' WHEN shape = 12 THEN '0' ELSE CAST(stay AS VARCHAR) END
         || ',"reviewerReviewedCount":' || CAST(l_linenumber AS VARCHAR) || '}}}}' END
    || ',"overallByProviders":[{{"providerId":' || CAST(external_id AS VARCHAR)
    || ',"provider":"' || provider_name || '","overallScore":' || rating_text
    || ',"reviewCount":' || CAST(l_linenumber AS VARCHAR)
    || ',"grades":{{"Cleanliness":' || rating_text || '}}}}]}}' AS full_line, shape
  FROM base
),
lines AS (
  SELECT file_key, line_no,
         CASE WHEN shape = 0 THEN '' WHEN shape = 1 THEN substr(full_line, 1, length(full_line) - 2)
              ELSE full_line END AS line
  FROM lines0
)"""

REVIEWS = f"""
reviews AS (
  SELECT l_orderkey * 100 + line_no AS id, l_partkey AS hotel_id, p_name AS hotel_name, platform, provider_id,
         CAST(external_id AS VARCHAR) AS provider_external_id, CAST(hrid AS VARCHAR) AS hotel_review_id,
         CAST(rating_text AS DOUBLE) AS rating, l_shipdate AS review_date, p_brand AS review_title,
         comments AS review_comments, lang AS translate_source, c_name AS reviewer_display_name,
         n_name AS reviewer_country_name, stay AS length_of_stay, l_linenumber AS reviewer_review_count,
         o_orderdate AS created_at,
         sha256(CAST(l_partkey AS VARCHAR) || '|' || {norm_text('comments')} || '|' || rating_text) AS content_hash,
         file_key AS processed_file_key, line_no, rating_text || ' of 10' AS rating_text_label, p_type AS room_type_name,
         lower(c_mktsegment) AS review_positives, CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS review_negatives
  FROM base
)"""


def _kind(path: str) -> str:
    t = f"json_type(json_extract(j, '{path}'))"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'VARCHAR' THEN 'string' WHEN {t} = 'OBJECT' THEN 'object' "
            f"WHEN {t} = 'ARRAY' THEN 'array' WHEN {t} = 'NULL' THEN 'null' WHEN {t} = 'BOOLEAN' THEN 'boolean' "
            f"ELSE 'number' END")


def _text(path: str) -> str:
    return f"json_extract_string(j, '{path}')"


_VDATE = (r"'^(\d{4}-\d{2}-\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
          r"|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})$'")
_LOCAL = r"'^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?)'"

PARSED = f"""
parsed0 AS (
  SELECT file_key, line_no, line,
         {jtrim('line')} = '' AS is_blank,
         CASE WHEN {jtrim('line')} <> '' AND json_valid({jtrim('line')}) THEN {jtrim('line')} END AS j
  FROM lines
),
parsed AS (
  SELECT file_key, line_no, line, is_blank, NOT is_blank AND j IS NULL AS is_malformed,
         {_kind('$.hotelId')} AS hotel_kind, {_text('$.hotelId')} AS hotel_text,
         {_kind('$.platform')} AS provider_kind, {_text('$.platform')} AS provider_text,
         {_kind('$.hotelName')} AS hotel_name_kind, {_text('$.hotelName')} AS hotel_name_text,
         {_kind('$.comment.rating')} AS rating_kind, {_text('$.comment.rating')} AS rating_text,
         {_kind('$.comment.reviewDate')} AS date_kind, {_text('$.comment.reviewDate')} AS date_text,
         {_kind('$.comment.hotelReviewId')} AS hrid_kind, {_text('$.comment.hotelReviewId')} AS hrid_text,
         {_text('$.comment.reviewComments')} AS comments_text,
         {_text('$.comment.reviewTitle')} AS title_text,
         coalesce({_text('$.comment.reviewerDisplayName')}, {_text('$.comment.reviewerInfo.displayMemberName')}) AS reviewer_name_text,
         {_text('$.comment.translateSource')} AS translate_source_text,
         {_kind('$.comment.reviewerInfo')} AS ri_kind,
         {_kind('$.comment.reviewerInfo.countryName')} AS country_kind, {_text('$.comment.reviewerInfo.countryName')} AS country_text,
         {_kind('$.comment.reviewerInfo.lengthOfStay')} AS stay_kind, {_text('$.comment.reviewerInfo.lengthOfStay')} AS stay_text,
         j
  FROM parsed0
),
typed AS (
  SELECT *,
    CASE WHEN hotel_kind = 'number' THEN coalesce(TRY_CAST(trunc(TRY_CAST(hotel_text AS DOUBLE)) AS INTEGER), 0)
         WHEN hotel_kind = 'string' THEN CASE WHEN regexp_full_match({jtrim('hotel_text')}, '[+-]?[0-9]+')
                                              THEN coalesce(TRY_CAST({jtrim('hotel_text')} AS INTEGER), 0)
                                              ELSE coalesce(TRY_CAST(trunc(TRY_CAST({jtrim('hotel_text')} AS DOUBLE)) AS INTEGER), 0) END
         WHEN hotel_kind = 'boolean' THEN CASE WHEN hotel_text = 'true' THEN 1 ELSE 0 END
         WHEN hotel_kind IN ('object', 'array') THEN 0 END AS hotel_id,
    CASE WHEN provider_kind IN ('object', 'array') THEN '' WHEN provider_kind <> 'null' THEN provider_text END AS provider,
    CASE WHEN hotel_name_kind IN ('object', 'array') THEN '' WHEN hotel_name_kind <> 'null' THEN hotel_name_text END AS hotel_name,
    CASE WHEN rating_kind = 'number' THEN TRY_CAST(rating_text AS DOUBLE)
         WHEN rating_kind = 'string' THEN TRY_CAST({jtrim('rating_text')} AS DOUBLE) END AS rating_value,
    CASE WHEN regexp_full_match(date_text, {_VDATE})
         THEN TRY_CAST(regexp_extract(date_text, {_LOCAL}, 1) AS TIMESTAMP) END AS review_date,
    CASE WHEN hrid_kind = 'number' THEN TRY_CAST(hrid_text AS DOUBLE)
         WHEN hrid_kind = 'string' AND regexp_full_match(hrid_text, '[+-]?[0-9]+') THEN TRY_CAST(hrid_text AS BIGINT) END AS hrid_value,
    CASE WHEN stay_kind = 'number' THEN TRY_CAST(stay_text AS DOUBLE)
         WHEN stay_kind = 'string' AND regexp_full_match(stay_text, '[+-]?[0-9]+') THEN TRY_CAST(stay_text AS INTEGER) END AS stay_value
  FROM parsed
)"""


def validated(as_of: str) -> str:
    now = f"TIMESTAMP '{as_of}'"
    return f"""
validated AS (
  SELECT *,
    CASE WHEN is_blank OR is_malformed THEN []::VARCHAR[] ELSE list_filter([
      CASE WHEN hotel_id IS NULL THEN 'Hotel ID is required' WHEN hotel_id <= 0 THEN 'Hotel ID must be positive' END,
      CASE WHEN provider IS NULL THEN 'Provider is required' WHEN {jtrim('provider')} = '' THEN 'Provider cannot be empty'
           WHEN provider NOT IN ('Agoda', 'Booking', 'Expedia') THEN 'Provider must be one of: Agoda, Booking, Expedia' END,
      CASE WHEN hotel_name IS NULL THEN 'Hotel name is required' WHEN {jtrim('hotel_name')} = '' THEN 'Hotel name cannot be empty'
           WHEN length(hotel_name) > 255 THEN 'Hotel name cannot exceed 255 characters' END,
      CASE WHEN rating_kind IN ('boolean', 'object', 'array') THEN 'Rating must be a valid number'
           WHEN rating_kind = 'string' AND rating_value IS NULL THEN 'Rating must be a valid number'
           WHEN rating_value < 0.0 OR rating_value > 10.0 THEN 'Rating must be between 0.0 and 10.0' END,
      CASE WHEN date_kind IS NULL OR date_kind = 'null' THEN 'Review date is required'
           WHEN review_date IS NULL THEN 'Invalid review date format'
           WHEN review_date > {now} THEN 'Review date cannot be in the future'
           WHEN review_date < {now} - INTERVAL 20 YEAR THEN 'Review date cannot be older than 20 years' END,
      CASE WHEN hrid_kind IS NULL OR hrid_kind = 'null' THEN NULL
           WHEN hrid_kind IN ('boolean', 'object', 'array') OR (hrid_kind = 'string' AND hrid_value IS NULL)
             THEN 'Hotel review ID must be a valid number'
           WHEN hrid_value < 1 THEN 'Hotel review ID must be positive' END,
      CASE WHEN length(comments_text) > 5000 THEN 'Review comments cannot exceed 5000 characters' END,
      CASE WHEN ri_kind = 'object' AND country_kind = 'string' AND {jtrim('country_text')} = ''
           THEN 'Country name cannot be empty when present' END,
      CASE WHEN ri_kind <> 'object' OR stay_kind IS NULL OR stay_kind = 'null' THEN NULL
           WHEN stay_kind IN ('boolean', 'object', 'array') OR (stay_kind = 'string' AND stay_value IS NULL)
             THEN 'Length of stay must be a valid number when present'
           WHEN stay_value < 1 THEN 'Length of stay must be positive when present' END
    ], lambda x: x IS NOT NULL) END AS errors
  FROM typed
)"""


def staged(as_of: str) -> str:
    """Per-line stage, transformed columns and the first-wins/limit outcome."""
    return validated(as_of) + f""",
staged AS (
  SELECT *,
    list_filter([CASE WHEN rating_value IS NULL THEN 'rating is required' END,
                 CASE WHEN length({jtrim('title_text')}) > 500 THEN 'review_title exceeds 500 characters' END,
                 CASE WHEN length({jtrim('translate_source_text')}) > 10 THEN 'translate_source exceeds 10 characters' END],
                lambda x: x IS NOT NULL) AS save_errors,
    CASE WHEN is_blank THEN 'blank' WHEN is_malformed THEN 'malformed' WHEN len(errors) > 0 THEN 'invalid'
         WHEN hrid_kind IS NULL OR hrid_kind = 'null' OR rating_value IS NULL OR length({jtrim('title_text')}) > 500
              OR length({jtrim('translate_source_text')}) > 10 THEN 'failed' ELSE 'candidate' END AS stage,
    CASE upper(provider) WHEN 'AGODA' THEN 'AGODA' WHEN 'BOOKING' THEN 'BOOKING' WHEN 'EXPEDIA' THEN 'EXPEDIA'
         WHEN 'AIRBNB' THEN 'AIRBNB' END AS platform,
    hrid_text AS hotel_review_id,
    CASE WHEN {jtrim('comments_text')} <> '' THEN {jtrim('comments_text')} END AS review_comments,
    CAST(hotel_id AS BIGINT) AS hotel_id_long,
    sha256(coalesce(CAST(hotel_id AS VARCHAR), 'null') || '|' || coalesce(lower({jtrim('comments_text')}), '') || '|'
           || coalesce(rating_text, '') || '|' || coalesce(date_text, '')) AS content_hash
  FROM validated
),
tagged0 AS (
  SELECT *,
    CASE WHEN stage = 'invalid' THEN errors
         WHEN stage = 'failed' AND (hrid_kind IS NULL OR hrid_kind = 'null')
           THEN ['Processing failed - Failed to transform review data: hotelReviewId is missing from comment data']
         WHEN stage = 'failed' THEN list_transform(save_errors, lambda x: 'Processing failed - ' || x)
         ELSE []::VARCHAR[] END AS line_errors
  FROM staged
),
cands AS (
  SELECT * FROM tagged0 WHERE stage = 'candidate'
),
winners AS (
  SELECT platform, hotel_review_id, min(file_key) AS wf FROM cands GROUP BY platform, hotel_review_id
),
winners2 AS (
  SELECT c.platform, c.hotel_review_id, c.file_key, min(c.line_no) AS line_no
  FROM cands c JOIN winners w ON c.platform = w.platform AND c.hotel_review_id = w.hotel_review_id AND c.file_key = w.wf
  GROUP BY c.platform, c.hotel_review_id, c.file_key
),
tagged AS (
  SELECT t.*,
    CASE WHEN t.stage <> 'candidate' THEN t.stage
         WHEN w.line_no IS NOT NULL THEN 'valid' ELSE 'duplicate' END AS outcome
  FROM tagged0 t
  LEFT JOIN winners2 w ON t.file_key = w.file_key AND t.line_no = w.line_no
)"""


LEDGER = f"""
processed_files AS (
  SELECT o_orderkey AS id,
         'reviews/' || o_orderpriority || '/order-' || CAST(o_orderkey AS VARCHAR) || '.jl' AS s3_key,
         md5(CAST(o_orderkey AS VARCHAR)) AS etag,
         CAST(round(o_totalprice * 100) AS BIGINT) AS file_size,
         o_orderdate AS last_modified_date,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'FAILED' ELSE 'IN_PROGRESS' END AS processing_status,
         CAST(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 97 ELSE 0 END AS INTEGER) AS records_processed,
         CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 7 + 1 ELSE 0 END AS INTEGER) AS records_failed,
         0 AS records_skipped,
         CASE WHEN o_orderstatus = 'O' THEN 'Failed to process file: reviews/' || o_orderpriority || '/order-'
              || CAST(o_orderkey AS VARCHAR) || '.jl' END AS error_message,
         {_case('o_custkey % 3', TD.FEED_NAMES[:3])} AS provider,
         o_orderdate AS created_at,
         CASE WHEN o_orderstatus IN ('F', 'O')
              THEN o_orderdate + INTERVAL 1 HOUR + to_minutes(CAST(o_orderkey % 120 AS BIGINT))
              ELSE o_orderdate + INTERVAL 1 HOUR END AS updated_at,
         o_orderdate + INTERVAL 1 HOUR AS processing_started_at,
         CASE WHEN o_orderstatus IN ('F', 'O')
              THEN o_orderdate + INTERVAL 1 HOUR + to_minutes(CAST(o_orderkey % 120 AS BIGINT)) END AS processing_completed_at
  FROM orders
)"""

_JOB_STATUS = ("CASE event_type WHEN 'view' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'IN_PROGRESS' "
               "WHEN 'signup' THEN 'PENDING' ELSE 'CANCELLED' END")
JOBS = f"""
jobs0 AS (
  SELECT *, {_JOB_STATUS} AS status, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS total_files FROM events
),
processing_jobs AS (
  SELECT 'job-' || CAST(event_id AS VARCHAR) AS processing_id, status,
         {_case('user_id % 4', TD.FEED_CODES)} AS provider,
         CASE WHEN status <> 'PENDING' THEN ts END AS start_time,
         CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED')
              THEN ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END AS end_time,
         total_files,
         CAST(CASE WHEN status = 'COMPLETED' THEN total_files WHEN status = 'FAILED' THEN floor(total_files / 2)
                   WHEN status = 'IN_PROGRESS' THEN floor(total_files / 3) ELSE 0 END AS INTEGER) AS processed_files,
         CAST(CASE WHEN status = 'FAILED' THEN total_files - floor(total_files / 2) ELSE 0 END AS INTEGER) AS failed_files,
         CAST(floor(value) AS INTEGER) AS total_reviews,
         CASE WHEN status = 'FAILED' THEN 'Processing failed for event ' || CAST(event_id AS VARCHAR) END AS error_message,
         'user-' || CAST(user_id AS VARCHAR) AS triggered_by,
         event_id % 2 = 0 AS is_asynchronous, 'reviews/' AS s3_prefix, 100 AS max_files,
         ts AS created_at,
         coalesce(CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED')
                       THEN ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END,
                  CASE WHEN status <> 'PENDING' THEN ts END, ts) AS updated_at
  FROM jobs0
)"""

_METRIC = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TD.METRIC_NAMES.items()) + " END"
METRICS = f"""
metrics AS (
  SELECT {_METRIC} AS metric, {_case('user_id % 3', TD.FEED_CODES[:3])} AS provider,
         CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, value, ts
  FROM events
)"""

_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
JOB_LOG = f"""
job_log AS (
  SELECT 'run-' || CAST(user_id AS VARCHAR) || '-' || CAST(day(ts) // 3 AS VARCHAR) AS processing_id, ts AS event_ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'IN_PROGRESS'
           WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'COMPLETED' END END AS status,
         CASE WHEN event_type = 'view' THEN {_K} % 10 END AS processed_files,
         CASE WHEN event_type = 'view' THEN {_K} % 3 END AS failed_files,
         CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INTEGER) END AS total_reviews,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'processed' END END AS file_list
  FROM events
)"""

_PROVIDER = f"'provider=' || {_case('user_id % 3', TD.FEED_CODES[:3])}"
_STATUS = "'status=' || CASE WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END"
METERS = f"""
meter_observations AS (
  SELECT CASE event_type WHEN 'view' THEN 'api.requests.total' WHEN 'click' THEN 'reviews.processed.total'
           WHEN 'purchase' THEN 'files.processed.total' WHEN 'signup' THEN 's3.operations.total'
           WHEN 'error' THEN 'validation.errors.total' END AS metric,
         CASE WHEN event_type = 'view' THEN 'endpoint=' || {_case('event_id % 3', TD.METER_ENDPOINTS)}
           WHEN event_type = 'signup' THEN 'operation=' || {_case('event_id % 4', TD.METER_OPERATIONS)}
           WHEN event_type = 'error' THEN 'error_type=' || CASE WHEN event_id % 2 = 0 THEN 'rating' ELSE 'date' END
           ELSE {_PROVIDER} END AS t1,
         CASE WHEN event_type = 'view' THEN 'method=' || CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END
           WHEN event_type = 'signup' THEN 'success=' || CASE WHEN event_id % 7 = 0 THEN 'false' ELSE 'true' END
           WHEN event_type = 'error' THEN {_PROVIDER} ELSE {_STATUS} END AS t2,
         CASE WHEN event_type = 'view' THEN 'status=' || CASE WHEN event_id % 5 = 0 THEN '500' ELSE '200' END END AS t3,
         CASE WHEN event_type = 'click' THEN CAST(floor(value) AS BIGINT) ELSE 1 END AS value
  FROM events
)"""

TEXTS = """
review_texts AS (
  SELECT doc_id AS id, text AS review_comments, lang AS translate_source, source AS hotel_name,
         doc_id % 997 AS hotel_id, CAST(n_chars % 101 AS DOUBLE) / 10.0 AS rating
  FROM documents
)"""


def with_ctes(names: list[str], body: str, as_of: str = TD.REVIEW_AS_OF, lines_filter: str | None = None) -> str:
    """Assemble ``WITH <ctes> <body>``; dependencies are pulled in."""
    parts: list[str] = []
    need = set(names)
    if need & {"lines", "parsed", "staged"}:
        need |= {"base", "lines"}
    if "reviews" in need:
        need.add("base")
    if "base" in need:
        parts.append(BASE)
    if "lines" in need:
        parts.append(LINES if lines_filter is None else LINES.replace(
            "  FROM lines0\n)", f"  FROM lines0 WHERE {lines_filter}\n)"))
    if "reviews" in need:
        parts.append(REVIEWS)
    if need & {"parsed", "staged"}:
        parts.append(PARSED)
    if "staged" in need:
        parts.append(staged(as_of))
    if "ledger" in need:
        parts.append(LEDGER)
    if "jobs" in need:
        parts.append(JOBS)
    if "metrics" in need:
        parts.append(METRICS)
    if "job_log" in need:
        parts.append(JOB_LOG)
    if "meters" in need:
        parts.append(METERS)
    if "texts" in need:
        parts.append(TEXTS)
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + body
