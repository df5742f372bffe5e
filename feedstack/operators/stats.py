"""Aggregations.

All are single ``groupBy``/``agg`` plans with map-side partial aggregation,
so a provider or status holding a third of the rows is combined before the
shuffle.  Averages are rounded to 6 decimals for stable comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import shift, ts
from ..functions.rows import sentiment
from .ledger import state_columns


def _avg(c: str | Column, default=None) -> Column:
    a = F.round(F.avg(c), 6)
    return F.coalesce(a, F.lit(default)) if default is not None else a


def review_statistics(reviews: DataFrame) -> DataFrame:
    """A1: count and average rating (0.0 when none) of a filtered set (Q-11: both filtered)."""
    return reviews.agg(F.count(F.lit(1)).alias("total_reviews"), _avg("rating", 0.0).alias("average_rating"))


def platform_statistics(reviews: DataFrame) -> DataFrame:
    """A2: per platform: count, average, min/max rating and date, sentiment counts."""
    s = sentiment(F.col("rating"))
    return reviews.groupBy("platform").agg(
        F.count(F.lit(1)).alias("review_count"),
        _avg("rating").alias("average_rating"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.min("review_date").alias("first_review_date"),
        F.max("review_date").alias("last_review_date"),
        F.count_if(s == "positive").alias("positive_count"),
        F.count_if(s == "neutral").alias("neutral_count"),
        F.count_if(s == "negative").alias("negative_count"),
    )


def totals(reviews: DataFrame, as_of: str, start: str, end: str) -> DataFrame:
    """A3, A4, A5, A10 in one pass: total, in date range (start 00:00 ..
    end 23:59:59), average rating (null when none), created before as_of."""
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col("review_date").between(ts(f"{start} 00:00:00"), ts(f"{end} 23:59:59"))).alias("reviews_in_range"),
        _avg("rating").alias("average_rating"),
        F.count_if(F.col("created_at") < ts(as_of)).alias("created_before"),
    )


def by_hotel(reviews: DataFrame) -> DataFrame:
    """A6 + A7: average rating and count per hotel."""
    return reviews.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("review_count"),
                                           _avg("rating").alias("average_rating"))


def by_provider(reviews: DataFrame, providers: DataFrame) -> DataFrame:
    """A8 + A9 via X1: count and average per provider code; every provider of
    the dimension is listed (0 / 0.0 when it has no review)."""
    per = reviews.groupBy("platform").agg(F.count(F.lit(1)).alias("review_count"),
                                          _avg("rating").alias("average_rating"))
    dim = providers.select(F.col("code").alias("platform"), F.col("name").alias("provider_name"))
    return dim.join(per, "platform", "left").select(
        "platform", "provider_name", F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"))


def file_counts(ledger: DataFrame) -> DataFrame:
    """Files by provider and the status they are in now."""
    return state_columns(ledger, "provider", "processing_status").groupBy("provider", "processing_status").agg(F.count(F.lit(1)).alias("file_count"))


def completion_counts(ledger: DataFrame, status: str, start: str, end: str) -> DataFrame:
    """Files completed before ``end``; of these with ``status``; with
    ``status`` and completed from ``start`` to ``end``."""
    at, st = F.col("processing_completed_at"), F.col("processing_status") == status
    return state_columns(ledger, "processing_completed_at", "processing_status").agg(
                      F.count_if(at < ts(end)).alias("completed_before"),
                      F.count_if(st & (at < ts(end))).alias("status_before"),
                      F.count_if(st & at.between(ts(start), ts(end))).alias("status_between"))


def file_statistics(ledger: DataFrame) -> DataFrame:
    """Per provider totals by status, success and failure rate in %
    (0 when the provider has no file; Q-12: total counts every file)."""
    st = F.col("processing_status")
    agg = state_columns(ledger, "provider", "processing_status").groupBy("provider").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(st == "PENDING").alias("pending_files"),
        F.count_if(st == "IN_PROGRESS").alias("processing_files"),
        F.count_if(st == "COMPLETED").alias("completed_files"),
        F.count_if(st == "FAILED").alias("failed_files"))
    rate = lambda c: F.when(F.col("total_files") > 0,
                            F.round(F.col(c) * F.lit(100.0) / F.col("total_files"), 6)).otherwise(F.lit(0.0))
    return agg.withColumns({"success_rate": rate("completed_files"), "failure_rate": rate("failed_files")})


def files_today(ledger: DataFrame, as_of: str) -> DataFrame:
    """A13 + A14: completed today, failed today (day of as_of), completed in total."""
    day = as_of[:10]
    today = F.col("processing_completed_at").between(ts(f"{day} 00:00:00"), ts(f"{day} 23:59:59"))
    st = F.col("processing_status")
    return state_columns(ledger, "processing_completed_at", "processing_status").agg(
        F.count_if(today & (st == "COMPLETED")).alias("processed_today"),
        F.count_if(today & (st == "FAILED")).alias("failed_today"),
        F.count_if(st == "COMPLETED").alias("total_processed"))


def job_statistics(jobs: DataFrame, since: str) -> DataFrame:
    """Jobs created since t by outcome and total reviews (0 when none)."""
    j = jobs.filter(F.col("created_at") >= ts(since))
    st = F.col("status")
    return j.agg(
        F.count_if(st == "COMPLETED").alias("completed_jobs"),
        F.count_if(st == "FAILED").alias("failed_jobs"),
        F.count_if(st == "IN_PROGRESS").alias("in_progress_jobs"),
        F.count_if(st == "CANCELLED").alias("cancelled_jobs"),
        F.coalesce(F.sum("total_reviews"), F.lit(0)).cast("long").alias("total_reviews"))


def job_count_status_range(jobs: DataFrame, status: str, start: str, end: str) -> DataFrame:
    """A16."""
    return jobs.filter((F.col("status") == status) & F.col("created_at").between(ts(start), ts(end))) \
        .agg(F.count(F.lit(1)).alias("job_count"))


def provider_status(jobs: DataFrame, providers_enum: DataFrame, as_of: str) -> DataFrame:
    """Per provider over the last 24 h: completed / failed / in progress,
    reviews, health, last job end and status; every enum provider listed."""
    recent = jobs.filter(F.col("created_at") >= shift(ts(as_of), hours=-24))
    st = F.col("status")
    per = recent.groupBy("provider").agg(
        F.count_if(st == "COMPLETED").alias("completed"),
        F.count_if(st == "FAILED").alias("failed"),
        F.count_if(st == "IN_PROGRESS").alias("in_progress"),
        F.coalesce(F.sum("total_reviews"), F.lit(0)).cast("long").alias("total_reviews"),
        F.max_by(F.struct("end_time", "status"), F.struct("end_time", "processing_id")).alias("_last"))
    out = providers_enum.select(F.col("code").alias("provider")).join(per, "provider", "left")
    c, f = F.coalesce("completed", F.lit(0)), F.coalesce("failed", F.lit(0))
    health = (F.when((f > 0) & (c == 0), F.lit("DOWN")).when(f > c, F.lit("DEGRADED")).otherwise(F.lit("UP")))
    return out.select(
        "provider", c.alias("completed"), f.alias("failed"),
        F.coalesce("in_progress", F.lit(0)).alias("in_progress"),
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        health.alias("health"),
        F.col("_last.end_time").alias("last_end_time"), F.col("_last.status").alias("last_status"))


def processing_health(ledger: DataFrame, as_of: str, active_jobs: int = 0) -> DataFrame:
    """One row: failure rate over the last 24 h (Q-10: after the cutoff),
    hours since the last completed file, and the issues: none is UP, one with
    a failure rate of at most twice the threshold DEGRADED, else DOWN."""
    def percent(rate):
        return (F.floor(rate * 10000 + 0.5) / 100).cast("string")

    now = ts(as_of)
    since = shift(now, hours=-K.HEALTH_STALE_HOURS)
    st = F.col("processing_status")
    recent = F.col("processing_completed_at") >= since
    agg = state_columns(ledger, "processing_completed_at", "processing_status").agg(
        F.count_if(recent & (st == "COMPLETED")).alias("recent_completed"),
        F.count_if(recent & (st == "FAILED")).alias("recent_failed"),
        F.max(F.when(st == "COMPLETED", F.col("processing_completed_at"))).alias("last_completed_at"))
    total = F.col("recent_completed") + F.col("recent_failed")
    rate = F.when(total > 0, F.col("recent_failed") / total).otherwise(F.lit(0.0))
    stale_h = F.timestamp_diff("HOUR", F.col("last_completed_at"), now)
    issues = F.filter(F.array(
        F.when(F.col("failure_rate") > K.HEALTH_FAILURE_RATE, F.concat(
            F.lit("Failure rate ("), percent(F.col("failure_rate")), F.lit("%) exceeds threshold ("),
            percent(F.lit(K.HEALTH_FAILURE_RATE)), F.lit("%)"))),
        F.when(F.col("stale_hours").isNull(), F.lit("No processing history available"))
        .when(F.col("stale_hours") > K.HEALTH_STALE_HOURS, F.concat(
            F.lit("Processing system is stale - last activity "), F.col("stale_hours").cast("string"), F.lit(" hours ago"))),
        F.when(F.lit(active_jobs) >= K.HEALTH_MAX_LOAD,
               F.lit(f"Processing capacity exceeded: {active_jobs}/{K.HEALTH_MAX_LOAD} concurrent files"))),
        lambda x: x.isNotNull())
    out = agg.withColumns({"failure_rate": rate, "stale_hours": stale_h})
    out = out.withColumn("issues", issues)
    status = (F.when(F.size("issues") == 0, F.lit("UP"))
              .when((F.size("issues") == 1) & (F.col("failure_rate") <= 2 * K.HEALTH_FAILURE_RATE), F.lit("DEGRADED"))
              .otherwise(F.lit("DOWN")))
    return out.select("recent_completed", "recent_failed", F.round(F.col("failure_rate") * 100, 2).alias("failure_rate_pct"),
                      "last_completed_at", "stale_hours", F.array_join("issues", "; ").alias("issues"),
                      status.alias("health"))


def health_thresholds(ledger: DataFrame, as_of: str, queue_size: int = 0, status: str = "RUNNING") -> DataFrame:
    """Indicator rules over today's counts: queue > 500 -> DOWN; failure
    rate > 10 % once >= 10 processed -> DOWN; PAUSED -> OUT_OF_SERVICE;
    ERROR/FAILED -> DOWN; success rate rounded to 2 decimals."""
    day = files_today(ledger, as_of)
    total = F.col("processed_today") + F.col("failed_today")
    fr = F.when(total > 0, F.col("failed_today") / total).otherwise(F.lit(0.0))
    health = (F.when(F.lit(status).isin("ERROR", "FAILED"), F.lit("DOWN"))
              .when(F.lit(status) == "PAUSED", F.lit("OUT_OF_SERVICE"))
              .when(F.lit(queue_size) > K.INDICATOR_QUEUE_DOWN, F.lit("DOWN"))
              .when((total >= K.INDICATOR_MIN_PROCESSED) & (fr > K.INDICATOR_FAILURE_RATE), F.lit("DOWN"))
              .otherwise(F.lit("UP")))
    return day.select("processed_today", "failed_today",
                      F.round(F.when(total > 0, F.col("processed_today") * 100.0 / total).otherwise(F.lit(100.0)), 2)
                      .alias("success_rate"), health.alias("health"))


def as_rows(one: DataFrame, name: str = "metric") -> DataFrame:
    """The columns of a one-row result as rows (``name``, value), all of one type."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias("value")) for c in one.columns])))


def metric_counters(metrics: DataFrame, tags: tuple[str, ...] = ("provider", "status")) -> DataFrame:
    """Counters summed by metric and tags (provider and status; operation
    and success; endpoint, method and status: whatever columns a meter has)."""
    return metrics.groupBy("metric", *tags).agg(
        F.count(F.lit(1)).alias("observations"), F.round(F.sum("value"), 6).alias("total"))


def meter_counters(observations: DataFrame) -> DataFrame:
    """A25 over meters that each have tags of their own: ``observations`` (metric, tags map<string, string>, value).  One row
    for each meter and set of tags, ``name=value`` in order of their names: all tags of an observation, each tag alone, and
    none (the meter's total); ``n_tags`` tells them apart.

    The observations are aggregated once, by all of their tags; the smaller sets sum that result.  A tag without a value
    has the empty value, a null map has no tag; values are whole increments."""
    tag = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    none = F.array().cast("array<string>")
    full = observations.select("metric", "value", F.coalesce(F.array_sort(F.transform(F.map_entries("tags"), tag)), none).alias(
        "tags")).groupBy("metric", "tags").agg(F.count(F.lit(1)).alias("observations"), F.sum("value").alias("total"))
    sets = F.array_distinct(F.concat(F.array("tags", none), F.transform("tags", lambda t: F.array(t))))
    return full.select("metric", F.explode(sets).alias("tags"), "observations", "total").groupBy("metric", "tags").agg(
        F.sum("observations").alias("observations"), F.sum("total").cast("long").alias("total")).select(
        "metric", F.concat_ws(",", "tags").alias("tags"), F.size("tags").alias("n_tags"), "observations", "total")


def metric_timers(metrics: DataFrame, accuracy: int = 100000) -> DataFrame:
    """Durations (value = ms) per metric and provider: count, sum, max,
    p50/p95/p99 and SLO bucket counts.  Percentiles use the mergeable
    approximate sketch (bounded memory per group, partial aggregation)."""
    v = F.col("value")
    b = K.SLO_BUCKETS_MS
    return metrics.groupBy("metric", "provider").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum(v), 6).alias("total_ms"),
        F.max(v).alias("max_ms"),
        F.percentile_approx(v, [0.5, 0.95, 0.99], accuracy).alias("pcts"),
        F.count_if(v <= b[0]).alias(f"le_{b[0]}ms"),
        F.count_if(v <= b[1]).alias(f"le_{b[1]}ms"),
        F.count_if(v <= b[2]).alias(f"le_{b[2]}ms"),
    ).select("metric", "provider", "count", "total_ms", "max_ms",
             F.col("pcts")[0].alias("p50_ms"), F.col("pcts")[1].alias("p95_ms"), F.col("pcts")[2].alias("p99_ms"),
             f"le_{b[0]}ms", f"le_{b[1]}ms", f"le_{b[2]}ms")


def metric_gauges(metrics: DataFrame) -> DataFrame:
    """Last value per gauge (by time; of equal times the larger value), truncated to long."""
    return metrics.groupBy("metric", "provider").agg(
        F.max_by("value", F.struct("ts", "value")).cast("long").alias("last_value"), F.max("ts").alias("last_ts"))


def provider_metrics(reviews: DataFrame, ledger: DataFrame, providers: DataFrame) -> DataFrame:
    """Per provider: reviews, average rating, completed and failed files;
    the full provider list by left joins of two aggregates."""
    r = reviews.groupBy("platform").agg(F.count(F.lit(1)).alias("review_count"),
                                        _avg("rating").alias("average_rating"))
    st = F.col("processing_status")
    f = state_columns(ledger, "provider", "processing_status").groupBy(F.upper("provider").alias("platform")).agg(
        F.count_if(st == "COMPLETED").alias("completed_files"), F.count_if(st == "FAILED").alias("failed_files"))
    dim = providers.select(F.col("code").alias("platform"))
    return dim.join(r, "platform", "left").join(f, "platform", "left").select(
        "platform", F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"),
        F.coalesce("completed_files", F.lit(0)).alias("completed_files"),
        F.coalesce("failed_files", F.lit(0)).alias("failed_files"))
