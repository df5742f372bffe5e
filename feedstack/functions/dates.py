"""Date parsing and day arithmetic.

Review dates are wall-clock values: an offset such as ``+07:00`` is dropped,
not applied.  Casting the local part to TIMESTAMP_NTZ does exactly that and
refuses impossible dates such as Feb 30 (Q-5).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes accepted by the line validator:
#   yyyy-MM-dd (10 chars, midnight), ISO local date-time,
#   yyyy-MM-ddTHH:mm:ss+offset, yyyy-MM-ddTHH:mm:ss.SSS+offset, yyyy-MM-dd HH:mm:ss
VALIDATOR_DATE_SHAPE = (
    r"^(\d{4}-\d{2}-\d{2}"
    r"|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
    r"|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})"
    r"|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\z"
)
# Shapes accepted by the transformer: the above plus ISO zoned date-times
# (offset, optional seconds/fraction, optional [Region/Zone] suffix).
TRANSFORM_DATE_SHAPE = (
    r"^(\d{4}-\d{2}-\d{2}"
    r"|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?((Z|[+-]\d{2}:\d{2}(:\d{2})?)(\[[^\]]+\])?)?"
    r"|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\z"
)
# The wall-clock part of any accepted shape.
_LOCAL_PART = r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_review_date(text, validator: bool = True) -> Column:
    """Text -> TIMESTAMP_NTZ keeping the wall clock; null when the text is
    not one of the accepted shapes or names an impossible date."""
    text = _c(text)
    shape = VALIDATOR_DATE_SHAPE if validator else TRANSFORM_DATE_SHAPE
    local = F.regexp_extract(text, _LOCAL_PART, 1)
    return F.when(text.rlike(shape), local.try_cast("timestamp_ntz"))


def ts(value: str | dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def start_of_day(d: str) -> Column:
    return F.lit(f"{d} 00:00:00").cast("timestamp_ntz")


def end_of_day(d: str) -> Column:
    return F.lit(f"{d} 23:59:59").cast("timestamp_ntz")


def shift(t, *, years: int = 0, days: int = 0, hours: int = 0) -> Column:
    """``t`` plus a calendar interval (negative values go back)."""
    out = _c(t)
    if years:
        out = out + F.make_ym_interval(F.lit(years), F.lit(0))
    if days or hours:
        out = out + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(0), F.lit(0))
    return out


def whole_days_between(start, end) -> Column:
    """Whole 24-hour days from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def millis_between(start, end) -> Column:
    return F.timestamp_diff("MILLISECOND", _c(start), _c(end))
