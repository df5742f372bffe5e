"""Rows narrowed by a bitmap of wanted keys, before an exact join shuffles them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one row of a bitmap (Spark's own size, 4 KB).
BITS = 32_768
#: Bits for each wanted key: about one other key in sixteen passes by chance.
BITS_A_KEY = 16
#: Rows of a bitmap at most (16 MB).  With more keys than they serve, more of the others pass; none that is wanted is lost.
MOST_ROWS = 4_096


def _bit(key: list[str | Column], rows: int) -> Column:
    """The bit of a key; nulls are hashed as well, so a null key has one."""
    return F.pmod(F.xxhash64(*key), F.lit(rows * BITS))


def narrowed(df: DataFrame, key: list[str | Column], wanted: DataFrame, wanted_key: list[str | Column], n: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among the ``n`` keys of ``wanted``: all that are, and a few others whose hash
    falls on the same bit.  ``wanted`` becomes a bitmap (a partial aggregate), which is broadcast; ``df`` is not shuffled.
    Both keys must have the same types.  An exact join follows."""
    rows = 1
    while rows < MOST_ROWS and rows * BITS < n * BITS_A_KEY:
        rows *= 2
    at = _bit(wanted_key, rows)
    bitmap = (wanted.select(F.floor(at / BITS).alias("_row"), (at % BITS).alias("_at"))
              .groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    at = _bit(key, rows)
    place = at % BITS
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return df.join(F.broadcast(bitmap), (F.floor(at / BITS) == F.col("_row")) & held, "left_semi")
