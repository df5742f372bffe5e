"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Word separators of the contracts: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 18


#: Bytes of an Arrow batch: texts may be long, and a Python worker holds a batch with several arrays made from it.
BATCH_BYTES = "8m"


def ship_package(spark: SparkSession) -> None:
    """Prepare ``spark`` for the operators: bound its Arrow batches, and give the package to the Python workers, once for
    each context, since they may start in another folder than the driver."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_feedstack_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="feedstack-package-"), "feedstack_package")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "feedstack"))
    sc._feedstack_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local session may fall back to a folder of its own."""
    return ensure_checkpoint_dir(spark, allow_local=spark.sparkContext.master.startswith(("local[", "local")) and
                                 not spark.sparkContext.master.startswith("local-cluster"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once in the shared folder: it cuts the lineage, survives lost executors and
    prunes columns when it is read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/feedstack-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._feedstack_path = path
    return out


@contextmanager
def joins_of_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, AQE does not turn a join whose sides are shuffled already into a broadcast: that only spares a sort, and
    the driver gathers a table for each.  Where a run has dozens of small joins, those tables and the threads that build
    them are what it holds most of.  Sides known to be small before the shuffle, and those marked, are broadcast as ever."""
    name = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._feedstack_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def empty_as(col: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n+1 bounds; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, bounds from 0)."""
    data, bounds = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i]
        i = j
    pa.default_memory_pool().release_unused()


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Python rows of Arrow batches."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, root) with root the smallest node, by alternating
    large-star and small-star steps; every step is a grouped minimum and a join, so no component is ever gathered
    in one place.  Each round is a written table, which the next round's replaces.  An empty input gives an empty result.

    A pair of steps at least halves the height of the paths to a component's smallest node, in practice; ``rounds`` only
    stops a run that would not settle, with an error."""
    x = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, last = written(edges.filter("a <> b").select(x.alias("x")).distinct().select("x.*"), "edges"), None

    def ends(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        """One row for each pair of columns that differ, as (u, v), without a second branch in the plan."""
        both = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
        return df.select(F.explode(both).alias("x")).select("x.*").filter("u <> v")

    for _ in range(rounds):
        both = ends(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        done, e = e, written(ends(small, ("u", "m"), ("v", "m")).distinct(), "edges")
        discard(done)
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
