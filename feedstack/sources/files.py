"""JSON-Lines files: listing (S2-S6) and line scanning with numbers.

Listing uses the ``binaryFile`` source with metadata columns only (the
content column is pruned from the read schema), so it never reads bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import ts

KEY, SIZE, MTIME = "s3_key", "file_size", "last_modified_date"


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file_key, line_no, line)`` for every line, 1-based per file.

    Each task reads whole splits; inside a split the row id from
    ``monotonically_increasing_id`` grows by one per line.  So a line's
    number is (lines in earlier splits of its file) + (id - first id of its
    split) + 1.  Only the per-split table (one row per split: count, first
    id) is aggregated and windowed, never the lines themselves, so a huge
    file costs no more than many small ones."""
    return number_lines(spark.read.text(paths)
                        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_key"),
                                F.col("_metadata.file_block_start").alias("_block")))


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers for raw lines ``(file_key, _block, line)`` by the offset of
    their split, as described for ``scan_lines``."""
    raw = lines.withColumn("_rid", F.monotonically_increasing_id())
    splits = raw.groupBy("file_key", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_rid0"))
    before = Window.partitionBy("file_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (raw.join(splits.select("file_key", "_block", "_rid0", "_offset"), ["file_key", "_block"])
            .select("file_key", (F.col("_offset") + F.col("_rid") - F.col("_rid0") + 1).cast("int").alias("line_no"),
                    "line"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """JSON-Lines files under ``root`` (recursive): size > 0, name ends
    with .jl / .jsonl (any case).  Columns: s3_key, file_size, last_modified_date."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(F.col("path").alias(KEY), F.col("length").alias(SIZE),
                     F.col("modificationTime").cast("timestamp_ntz").alias(MTIME)))
    return valid_files(files)


def valid_files(files: DataFrame) -> DataFrame:
    low = F.lower(F.col(KEY))
    ext = F.lit(False)
    for e in K.JSONL_EXTENSIONS:
        ext = ext | low.endswith(e)
    return files.filter(~F.col(KEY).endswith("/") & (F.col(SIZE) > 0) & ext)


def list_new_files(files: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """S3: all files modified strictly after ``since`` (unknown mtime
    included), oldest first; only the first ``limit`` where a caller asks."""
    f = valid_files(files)
    if since is not None:
        f = f.filter(F.col(MTIME).isNull() | (F.col(MTIME) > ts(since)))
    f = f.orderBy(F.col(MTIME).asc_nulls_first(), KEY)
    return f if limit is None else f.limit(limit)


def file_metadata(files: DataFrame, key: str) -> DataFrame:
    """Metadata of one key; an empty key is an argument error."""
    if key is None or not key.strip():
        raise ValueError("File key cannot be null or empty")
    return files.filter(F.col(KEY) == key)


def files_exist(files: DataFrame, keys: DataFrame) -> DataFrame:
    """S5 for many keys: the keys that exist (semi join)."""
    return keys.join(files.select(KEY), KEY, "left_semi")


def total_file_size(files: DataFrame) -> DataFrame:
    """S6."""
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.sum(SIZE).cast("long").alias("total_size"))


def stream_lines(spark: SparkSession, root: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Newly arriving JSON-Lines files as a stream of raw lines with
    their file path (numbered per micro-batch by ``number_lines``)."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", "*.{[jJ][lL],[jJ][sS][oO][nN][lL]}").load(root)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_key"),
                    F.col("_metadata.file_block_start").alias("_block")))
