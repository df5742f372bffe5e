"""Deduplication and existence joins (W1, W2, X3, X7, N20; X2 is in
``feedstack.sources.providers``).

Hot keys: every grouping here is an aggregate with a map-side partial step
(``min`` over a struct, ``count``), never a per-key window, so a key that
holds a third of all rows is combined before the shuffle.  Results are
joined back on unique keys (file, line) so the join itself is not skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bitmaps import narrowed
from ..session import staged

REVIEW_KEY = ["platform", "hotel_review_id"]


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """For each key the row position (``order`` columns) that comes first.
    Returns key + order columns, one row per key."""
    first = F.min(F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"_first.{c}").alias(c) for c in order])


def dedup_in_batch(df: DataFrame, key: list[str] | None = None,
                   order: list[str] | None = None) -> DataFrame:
    """Keep the first row per key (by file, line); ties impossible since
    (file, line) is unique."""
    key = key or REVIEW_KEY
    order = order or ["file_key", "line_no"]
    winners = first_per_key(df, key, order)
    return df.join(winners.select(*order), order, "left_semi")


def dedup_against_store(df: DataFrame, store: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose key is not stored yet (anti join; duplicate store keys
    never multiply rows)."""
    key = key or REVIEW_KEY
    return df.join(store.select(*key), key, "left_anti")


#: A group is heavy when it holds more than 1 / (SHARES * shuffle partitions) of all rows in groups.
SHARES = 4


def salted(reviews: DataFrame, groups: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and groups (``key``, ``_n`` rows each) with a ``_salt`` that deals the rows of a heavy group over shares of about
    equal size, by a hash of the row.  The heavy groups are fewer than SHARES * shuffle partitions whatever the data,
    so they are broadcast; a group that is not heavy has one share."""
    shares = SHARES * int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = groups.agg(F.sum("_n").alias("n")).first().n or 0
    sized = groups.withColumn("_shares", F.greatest(F.ceil(F.col("_n") * shares / F.lit(max(total, 1))), F.lit(1)).cast("int"))
    heavy = F.broadcast(sized.filter("_shares > 1").select(*key, "_shares"))
    plain = [c for c, t in reviews.dtypes if t.split("<")[0] not in ("array", "map", "struct", "variant")]
    salt = F.coalesce(F.pmod(F.xxhash64(*plain), F.col("_shares")), F.lit(0)).cast("int")
    rows = reviews.join(heavy, key, "left").withColumn("_salt", salt).drop("_shares")
    return rows, sized.select(*key, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_salt"))


def potential_duplicates(reviews: DataFrame) -> DataFrame:
    """Every review whose (hotel_id, content_hash) group has > 1 row.
    First the 64-bit hashes of all keys are counted; only rows whose hash
    comes twice can be in a group, so only those (and what a bitmap of these
    hashes lets through) are shuffled with their key.
    Their groups are counted by a partial aggregate and written once; the semi
    join goes back on the (unique) group key and a salt that splits the rows
    of heavy groups, so no task gets a group whole.  A row without a hotel or
    a hash is in no group."""
    key = ["hotel_id", "content_hash"]
    keyed = reviews.filter(F.col("hotel_id").isNotNull() & F.col("content_hash").isNotNull())
    twice = staged(keyed.groupBy(F.xxhash64(*key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "twice")
    likely = staged(narrowed(keyed, [F.xxhash64(*key)], twice, ["_key"], twice.count()), "likely", "zstd")
    groups = staged(likely.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "groups")
    rows, shares = salted(likely, groups, key)
    return rows.join(shares, [*key, "_salt"], "left_semi").select(*reviews.columns)


def latest_per_key(events: DataFrame, key: list[str], order: list[str], value_cols: list[str]) -> DataFrame:
    """Current state per key out of an event log (``max_by`` over the
    event time and the sequence number after it, so ties are decided; a
    partial aggregate, safe for hot keys)."""
    latest = F.max_by(F.struct(*value_cols), F.struct(*order)).alias("_s")
    return events.groupBy(*key).agg(latest).select(*key, *[F.col(f"_s.{c}").alias(c) for c in value_cols])
