"""The key table of a review store (X3, ST2): which review keys are stored, dealt into folders by key hash.

Each batch writes the keys that it stores into ``batch_id=<id>/bucket=<b>``.  A new batch reads only the folders that its own
keys fall in: their numbers, at most ``BUCKETS`` rows, are broadcast, and dynamic partition pruning drops the other folders
before they are read.  In a folder the keys are sorted by their hash, so that the statistics of its row groups are narrow.
The join has one row for each new key, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import REVIEW_KEY
from . import tables

#: Folders of a key table; fixed for the life of a store.
BUCKETS = 256


def with_bucket(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``df`` with ``key_hash`` and the folder ``bucket`` of its key."""
    hashed = F.xxhash64(*(key or REVIEW_KEY))
    return df.withColumns({"key_hash": hashed, "bucket": F.pmod(hashed, F.lit(BUCKETS)).cast("int")})


def write_keys(reviews: DataFrame, root: str, batch_id: str) -> str:
    """Write the keys of the reviews that a batch stores; a replay replaces them."""
    keyed = with_bucket(reviews.select(*REVIEW_KEY)).repartition("bucket").sortWithinPartitions("bucket", "key_hash")
    return tables.write_batch(keyed, root, batch_id, ["bucket"])


def stored_keys(spark: SparkSession, root: str, new: DataFrame, batch_id: str | None = None) -> DataFrame:
    """The keys of ``new`` that other batches than ``batch_id`` have stored (each once); null keys equal nothing."""
    wanted = with_bucket(new.select(*REVIEW_KEY))
    stored = tables.read_store(spark, root)
    if stored is None:
        return new.select(*REVIEW_KEY).limit(0)
    if batch_id is not None:
        stored = stored.filter(F.col("batch_id") != batch_id)
    # a filter that holds for every folder: pruning looks for one on the side that it prunes by
    folders = F.broadcast(wanted.filter(F.col("bucket") >= 0).select("bucket").distinct())
    near = stored.join(folders, "bucket").select("bucket", "key_hash", *REVIEW_KEY)
    return wanted.join(near, ["bucket", "key_hash", *REVIEW_KEY], "left_semi").select(*REVIEW_KEY)


def rebuild_keys(spark: SparkSession, reviews_root: str, root: str) -> None:
    """A key table for a store that has none, or one that was purged: a batch of keys for each batch of reviews."""
    for b in sorted({*tables.committed_batches(spark, reviews_root), *tables.last_version(spark, reviews_root)["inside"]}):
        write_keys(tables.read_store(spark, reviews_root).filter(F.col("batch_id") == b), root, b)
