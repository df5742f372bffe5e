"""Session helpers.

Library code never creates its own cluster settings: it takes the session it is
given.  ``local_session`` is for tests, the bench and the smoke entry only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness of the plans in this package.
# Timestamps in the review model are wall-clock (TIMESTAMP_NTZ); pin UTC so
# that any conversion that does touch a zone is deterministic.
CORRECTNESS_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Settings that matter for scale: AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold, sort-merge
# otherwise), coalesces small shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "feedstack") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in {**CORRECTNESS_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """Apply the correctness settings to a session created elsewhere."""
    for k, v in CORRECTNESS_CONF.items():
        spark.conf.set(k, v)
    return spark


@contextmanager
def several_tasks_a_core(spark: SparkSession, tasks: int = 4) -> Iterator[None]:
    """Inside, AQE merges small shuffle partitions to no fewer than ``tasks``
    tasks a core.  Its own measure is one a core, by the bytes shuffled: where
    the work on a row outweighs its bytes, a last task then runs alone.  A
    number set in the session is left as it is."""
    name = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
    ours = spark.conf.get(name, None) is None
    if ours:
        spark.conf.set(name, str(tasks * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(name)


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read
    back: its consumers read only the columns they need, nothing stays cached
    in the session, and a lost executor costs no recomputation.
    ``compression``: a Parquet codec other than the session's."""
    spark = df.sparkSession
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    path = f"{ensure_checkpoint_dir(spark, allow_local=local).rstrip('/')}/feedstack-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table made by ``staged`` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir`` (the
    shared folder of the cluster).  Only local sessions (tests, bench) may
    fall back to a fresh scratch folder when it is unset; library code
    raises instead of writing to a machine-local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not allow_local:
        raise ValueError("spark.checkpoint.dir is not set; set it to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="feedstack-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
