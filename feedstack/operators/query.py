"""Read path: dynamic filters (F1-F9), named finders (N1-N26), paging.

Filters are folded into one ``Column`` with ``&``; Catalyst pushes the
parts that touch stored columns into the parquet scan (PushedFilters) and
prunes partitions on ``platform`` when the store is partitioned by it.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import end_of_day, start_of_day, ts
from ..functions.text import contains_ci


@dataclasses.dataclass(frozen=True)
class ReviewFilter:
    """Optional clauses; ``None`` means "no constraint" (F1-F8)."""
    hotel_id: int | None = None
    platform: str | None = None
    min_rating: float | None = None
    max_rating: float | None = None
    reviewer_country: str | None = None
    hotel_name: str | None = None
    start_date: str | None = None   # yyyy-MM-dd, from 00:00:00
    end_date: str | None = None     # yyyy-MM-dd, to 23:59:59 inclusive
    min_length_of_stay: int | None = None
    max_length_of_stay: int | None = None
    search: str | None = None       # F8: contains in comments, title or hotel name

    def check(self) -> None:
        """Argument checks done on the driver before the plan is built."""
        for name in ("min_rating", "max_rating"):
            val = getattr(self, name)
            if val is not None and not 0.0 <= val <= 10.0:
                raise ValueError(f"{name} must be between 0 and 10")
        if self.hotel_id is not None and self.hotel_id <= 0:
            raise ValueError("hotel_id must be positive")
        for name in ("min_length_of_stay", "max_length_of_stay"):
            val = getattr(self, name)
            if val is not None and val < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("start_date", "end_date"):
            val = getattr(self, name)
            if val is not None:
                dt.date.fromisoformat(val)


def filter_predicate(f: ReviewFilter | None) -> Column:
    """AND of the present clauses; no filter -> TRUE."""
    if f is None:
        return F.lit(True)
    f.check()
    clauses: list[Column] = []
    if f.hotel_id is not None:
        clauses.append(F.col("hotel_id") == f.hotel_id)                         # F1
    if f.platform is not None:
        clauses.append(F.col("platform") == f.platform.upper())                  # F2
    if f.min_rating is not None:
        clauses.append(F.col("rating") >= f.min_rating)                          # F3
    if f.max_rating is not None:
        clauses.append(F.col("rating") <= f.max_rating)
    if f.reviewer_country is not None and f.reviewer_country.strip():
        clauses.append(F.col("reviewer_country_name") == f.reviewer_country)     # F4
    if f.hotel_name is not None and f.hotel_name.strip():
        clauses.append(contains_ci("hotel_name", f.hotel_name))                  # F5
    if f.start_date is not None:
        clauses.append(F.col("review_date") >= start_of_day(f.start_date))       # F6
    if f.end_date is not None:
        clauses.append(F.col("review_date") <= end_of_day(f.end_date))
    if f.min_length_of_stay is not None:
        clauses.append(F.col("length_of_stay") >= f.min_length_of_stay)          # F7
    if f.max_length_of_stay is not None:
        clauses.append(F.col("length_of_stay") <= f.max_length_of_stay)
    if f.search is not None and f.search.strip():
        clauses.append(contains_ci("review_comments", f.search)                  # F8
                       | contains_ci("review_title", f.search)
                       | contains_ci("hotel_name", f.search))
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def apply_filters(reviews: DataFrame, f: ReviewFilter | None) -> DataFrame:
    return reviews.filter(filter_predicate(f))


# --- named finders (N) ------------------------------------------------------

def equal(**values) -> Column:
    """Every named column has its value."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()])


def at_least(column: str, x: float) -> Column:
    return F.col(column) >= F.lit(x)


def between(column: str, lo: float, hi: float) -> Column:
    return F.col(column).between(lo, hi)


def time_between(column: str, start: str, end: str) -> Column:
    return F.col(column).between(ts(start), ts(end))


def since(column: str, start: str) -> Column:
    return F.col(column) >= ts(start)


def by_column(reviews: DataFrame, column: str, value) -> DataFrame:
    """Equality finders as a filter."""
    return reviews.filter(equal(**{column: value}))


def review_by_id(reviews: DataFrame, review_id: int) -> DataFrame:
    """One review; an absent id is an error."""
    found = by_column(reviews, "id", review_id)
    if found.isEmpty():
        raise LookupError(f"Review not found with id: {review_id}")
    return found


def matches(df: DataFrame, finders: dict[str, Column], columns: list[str]) -> DataFrame:
    """Many finders in one pass: ``columns`` and ``finder`` for each finder that
    a row matches."""
    hits = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in finders.items()]), lambda x: x.isNotNull())
    return df.select(*columns, F.explode(hits).alias("finder"))


def hotel_language_page(reviews: DataFrame, hotel_id: int, language: str, page_no: int = 0, size: int = 20) -> DataFrame:
    """A hotel's reviews in one language, newest first, by pages."""
    return page(reviews.filter(equal(hotel_id=hotel_id, translate_source=language)), page_no, size)


def review_files(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """Every review with the ledger row of its file (``files``: one row for
    each key; null columns where it is unknown).  A file that holds a large
    part of all reviews is on the left side only, where AQE may split it."""
    f = files.select(F.col("s3_key").alias("_key"), "etag", F.col("processing_status").alias("file_status"))
    return reviews.join(f, F.col("processed_file_key") == F.col("_key"), "left").drop("_key")


def rating_at_least(reviews: DataFrame, x: float) -> DataFrame:
    return reviews.filter(at_least("rating", x))                                 # N5


def rating_between(reviews: DataFrame, lo: float, hi: float) -> DataFrame:
    return reviews.filter(between("rating", lo, hi))                             # N6


def date_between(reviews: DataFrame, start: str, end: str, column: str = "review_date") -> DataFrame:
    return reviews.filter(time_between(column, start, end))                      # N7, N16


def hotel_min_rating(reviews: DataFrame, hotel_id: int, min_rating: float) -> DataFrame:
    return reviews.filter(equal(hotel_id=hotel_id) & at_least("rating", min_rating))           # N10


def recent_by_provider(reviews: DataFrame, providers: DataFrame, code: str, since: str) -> DataFrame:
    """Join the provider dimension, review_date > since, newest first."""
    p = providers.filter(F.col("code") == code).select(F.col("code").alias("platform"))
    return (reviews.join(p, "platform").filter(F.col("review_date") > ts(since))
            .orderBy(F.col("review_date").desc_nulls_first(), F.col("id")))


def complex_criteria(reviews: DataFrame, hotel_id: int, start: str, end: str, min_rating: float) -> DataFrame:
    """Hotel, date range, min rating, newest first."""
    return (reviews.filter(equal(hotel_id=hotel_id) & time_between("review_date", start, end) & at_least("rating", min_rating))
            .orderBy(F.col("review_date").desc_nulls_first(), F.col("id")))


def hotel_name_contains(reviews: DataFrame, text: str) -> DataFrame:
    return reviews.filter(contains_ci("hotel_name", text))                      # N17, N23


def recent_reviews(reviews: DataFrame, cutoff: str) -> DataFrame:
    return reviews.filter(since("created_at", cutoff)).orderBy(F.col("created_at").desc(), "id")  # N18


def high_rated(reviews: DataFrame, threshold: float) -> DataFrame:
    return reviews.filter(F.col("rating") > threshold).orderBy(F.col("rating").desc(), "id")  # N19


def exists_keys(reviews: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Which of many keys exist (one semi join, not a lookup per key)."""
    return keys.join(reviews.select(*on), on, "left_semi")


# --- paging (P) ---------------------------------------------------------------

def page(df: DataFrame, page_no: int = 0, size: int = 20, order: list[Column] | None = None,
         tie_break: str = "id") -> DataFrame:
    """One page in a total order (a unique tie-break is always added).
    ``orderBy + offset + limit`` plans as a TakeOrderedAndProject: each task
    keeps its own top (offset+size) rows, the driver merges them."""
    order = order or [F.col("review_date").desc_nulls_first()]
    return df.orderBy(*order, F.col(tie_break)).offset(page_no * size).limit(size)


#: Rows that a deep page may sort at once, and the accuracy (1/rank error) of the sketch that narrows it down.
DEEP_ROWS, DEEP_ACCURACY = 100_000, 10_000


def page_deep(df: DataFrame, page_no: int, size: int = 20, tie_break: str = "id", rows: int = DEEP_ROWS) -> DataFrame:
    """P1 for pages far down, in the order of ``page``: no task holds the rows before the page.

    A mergeable sketch of the sort key gives two values around the ranks of the page; one aggregate counts exactly the rows
    before, at, between and after them; only the parts that hold rows of the page go on, and those with one date are
    split further by ``tie_break`` (a unique whole number).  Parts of up to ``rows`` rows are sorted.  Counts, at most
    five a step, are all that reaches the driver.  A page beyond the last row is empty."""
    # ascending whole numbers: later dates first, rows without a date before them
    keyed = df.withColumns({"_at": F.coalesce(-F.unix_micros(F.col("review_date").cast("timestamp")), F.lit(-(1 << 63))),
                            "_tie": F.col(tie_break).cast("long")})
    pieces = _located(keyed, ["_at", "_tie"], page_no * size, size, rows)
    found = pieces[0] if pieces else keyed.limit(0)
    for piece in pieces[1:]:
        found = found.unionByName(piece)
    return found.orderBy("_at", "_tie").select(*df.columns)


def _located(df: DataFrame, keys: list[str], skip: int, take: int, rows: int) -> list[DataFrame]:
    """The rows ``skip`` to ``skip + take`` of ``df`` in the order of ``keys``, as sorted parts."""
    n = df.count()
    if skip >= n or take <= 0:
        return []
    if n <= rows or not keys:
        return [df.orderBy(*keys, "_tie").offset(skip).limit(take)]
    key, slack = F.col(keys[0]), 2 / DEEP_ACCURACY
    share = [max(0.0, skip / n - slack), min(1.0, (skip + take) / n + slack)]
    low, high = df.agg(F.percentile_approx(key, share, DEEP_ACCURACY).alias("p")).first().p
    parts = [(key < low, keys), (key == low, keys[1:])]
    if high > low:
        parts += [((key > low) & (key < high), keys), (key == high, keys[1:])]
    parts.append((key > high, keys))
    counts = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, (cond, _) in enumerate(parts)]).first()
    out, before = [], 0
    for (cond, rest), count in zip(parts, counts, strict=True):
        first, end = max(skip - before, 0), min(skip + take - before, count)
        if first < end:
            out += _located(df.filter(cond), rest, first, end - first, rows)
        before += count
    return out


def page_info(df: DataFrame, size: int = 20) -> DataFrame:
    """Total elements and pages of a filtered result (one count)."""
    return df.agg(F.count(F.lit(1)).alias("total_elements")).withColumn(
        "total_pages", F.ceil(F.col("total_elements") / F.lit(size)).cast("long"))


def page_after(df: DataFrame, last_date=None, last_id=None, size: int = 20) -> DataFrame:
    """Keyset page: the rows after (review_date, id) in (date desc
    nulls first, id asc) order, without scanning skipped pages.  A null
    ``last_date`` is a row without a date; without ``last_id`` as well, it is
    the first page."""
    d, i = F.col("review_date"), F.col("id")
    if last_id is None:
        after = F.lit(True)
    elif last_date is None:
        after = d.isNotNull() | (i > F.lit(last_id))
    else:
        after = (d < ts(last_date)) | ((d == ts(last_date)) & (i > F.lit(last_id)))
    return df.filter(after).orderBy(d.desc_nulls_first(), i).limit(size)


def top_by(df: DataFrame, column: str, n: int = 1, desc: bool = True, tie_break: str | None = None) -> DataFrame:
    """Top-n by a column (e.g. latest job / latest file / oldest file)."""
    c = F.col(column).desc_nulls_last() if desc else F.col(column).asc_nulls_last()
    order = [c] + ([F.col(tie_break)] if tie_break else [])
    return df.orderBy(*order).limit(n)


def providers_by_name(providers: DataFrame, names: DataFrame) -> DataFrame:
    """For each distinct ``name`` of a table the provider of exactly that name (case counts), and whether there is one;
    a null name has none.  ``providers`` is joined as ``providers.sized`` marked it: broadcast only while it is small."""
    found = names.select("name").distinct().join(providers.select("name", "id", "code"), "name", "left")
    return found.withColumn("name_exists", F.col("id").isNotNull())
