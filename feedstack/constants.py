"""Fixed values of the review model.

These values must equal the ones of the system being re-implemented for the
results (validation messages, enum names, limits) to match.  They are stated
here once, in natural order, and every operator reads them from this module.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: providers
# ---------------------------------------------------------------------------
# Provider enum: (code, display name), in declaration order.
PROVIDER_TYPES = [
    ("AGODA", "Agoda"),
    ("BOOKING", "Booking"),
    ("EXPEDIA", "Expedia"),
    ("AIRBNB", "Airbnb"),
    ("VERY_LONG_LONG_PROVIDER_TYPE", "VERY_LONG_LONG_PROVIDER_TYPE"),
    ("INACTIVE", "Inactive"),
]
# Providers accepted by the line validator (exact, case-sensitive).
VALID_FEED_PROVIDERS = ["Agoda", "Booking", "Expedia"]

# ---------------------------------------------------------------------------
# FIXED VALUES: statuses
# ---------------------------------------------------------------------------
PROCESSING_STATUSES = ["PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "CANCELLED", "IDLE", "SKIPPED"]
TERMINAL_STATUSES = ["COMPLETED", "FAILED", "CANCELLED", "SKIPPED"]
ACTIVE_STATUSES = ["PENDING", "IN_PROGRESS"]
# Statuses removed by the created-date cleanup rule.
CLEANUP_STATUSES = ["COMPLETED", "FAILED", "SKIPPED"]

# ---------------------------------------------------------------------------
# FIXED VALUES: validation limits and messages (line validator)
# ---------------------------------------------------------------------------
MAX_HOTEL_NAME_LENGTH = 255
MAX_REVIEW_COMMENTS_LENGTH = 5000
MIN_RATING = 0.0
MAX_RATING = 10.0
MAX_REVIEW_AGE_YEARS = 20

MSG_NULL_RECORD = "Review data cannot be null"
MSG_HOTEL_ID_REQUIRED = "Hotel ID is required"
MSG_HOTEL_ID_POSITIVE = "Hotel ID must be positive"
MSG_PROVIDER_REQUIRED = "Provider is required"
MSG_PROVIDER_EMPTY = "Provider cannot be empty"
MSG_PROVIDER_UNKNOWN = "Provider must be one of: Agoda, Booking, Expedia"
MSG_HOTEL_NAME_REQUIRED = "Hotel name is required"
MSG_HOTEL_NAME_EMPTY = "Hotel name cannot be empty"
MSG_HOTEL_NAME_TOO_LONG = "Hotel name cannot exceed 255 characters"
MSG_COMMENT_REQUIRED = "Comment section is required"
MSG_RATING_RANGE = "Rating must be between 0.0 and 10.0"
MSG_RATING_NUMBER = "Rating must be a valid number"
MSG_DATE_REQUIRED = "Review date is required"
MSG_DATE_FORMAT = "Invalid review date format"
MSG_DATE_FUTURE = "Review date cannot be in the future"
MSG_DATE_TOO_OLD = "Review date cannot be older than 20 years"
MSG_REVIEW_ID_NUMBER = "Hotel review ID must be a valid number"
MSG_REVIEW_ID_POSITIVE = "Hotel review ID must be positive"
MSG_COMMENTS_TOO_LONG = "Review comments cannot exceed 5000 characters"
MSG_COUNTRY_EMPTY = "Country name cannot be empty when present"
MSG_STAY_NUMBER = "Length of stay must be a valid number when present"
MSG_STAY_POSITIVE = "Length of stay must be positive when present"
# Transform failure for a line without a review id.
MSG_REVIEW_ID_MISSING = ("Processing failed - Failed to transform review data: "
                         "hotelReviewId is missing from comment data")

# ---------------------------------------------------------------------------
# FIXED VALUES: stored-entity limits (second gate, at save)
# ---------------------------------------------------------------------------
REVIEW_MAX_LENGTHS = [
    ("hotel_name", 300),
    ("hotel_review_id", 100),
    ("formatted_rating", 20),
    ("rating_text", 50),
    ("review_comments", 10000),
    ("review_title", 500),
    ("review_negatives", 5000),
    ("review_positives", 5000),
    ("original_title", 500),
    ("original_comment", 10000),
    ("translate_source", 10),
    ("translate_target", 10),
    ("content_hash", 64),
    ("formatted_review_date", 50),
    ("check_in_date_month_and_year", 50),
    ("encrypted_review_data", 500),
]
#: Before the reason why the store refuses a row.
SAVE_FAILED = "Processing failed - "
PROVIDER_NAME_MAX = 100
PROVIDER_DESCRIPTION_MAX = 500
PROVIDER_ENDPOINT_MAX = 255
PROVIDER_LANGUAGES_MAX = 200
PROVIDER_URL_PATTERN = r"^(https?://)[a-zA-Z0-9.-]+(:[0-9]+)?(/.*)?\z"
LEDGER_KEY_MAX = 1024
LEDGER_ETAG_MAX = 255
LEDGER_PROVIDER_MAX = 50
LEDGER_ERROR_MAX = 2000

# ---------------------------------------------------------------------------
# FIXED VALUES: pipeline, ledger and health parameters
# ---------------------------------------------------------------------------
CHUNK_SIZE = 1000
ERROR_SUMMARY_HEAD = 10
ERROR_SUMMARY_KEEP = 50  # the summary starts at the 50th error from the end
ERROR_LINE_PREVIEW = 100
STUCK_AFTER_HOURS = 2
STUCK_MESSAGE = "Processing timeout - file was stuck in processing state"
CLEANUP_AFTER_DAYS = 30
JOB_HISTORY_DEFAULT_DAYS = 30
HEALTH_FAILURE_RATE = 0.1
HEALTH_STALE_HOURS = 24
HEALTH_MAX_LOAD = 5
INDICATOR_QUEUE_DOWN = 500
INDICATOR_FAILURE_RATE = 0.1
INDICATOR_MIN_PROCESSED = 10
SLO_BUCKETS_MS = [100, 500, 1000]
SENTIMENT_POSITIVE_MIN = 7.0
SENTIMENT_NEGATIVE_BELOW = 5.0
RECENT_DAYS = 30
EXPERIENCED_REVIEWER_MIN = 5
JSONL_EXTENSIONS = [".jl", ".jsonl"]
