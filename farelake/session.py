"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
RUNTIME_SETTINGS = {
    # No zone shifts: every clock in the warehouse is a zone-less timestamp.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    # Re-plan at each shuffle: coalesce small partitions, split hot ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A side is broadcast only when Spark's own size figure is below this.
    "spark.sql.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Parquet files are compressed, calendars and repeated values very much so; count them
    # larger before deciding that a side is small.
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # Replace only the partitions a load touches.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state lives on disk with changelogs in the checkpoint folder.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the warehouse's runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "farelake", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or get) a session with the warehouse's settings.

    ``master`` and ``shuffle_partitions`` are left to the cluster's own
    configuration unless given; local runs and tests pass both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a statement go when it ends, not when the driver next collects garbage.

    For jobs of many statements in which each reads stored tables only, so that no statement needs another's shuffles.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


# The scratch folders of bare local sessions, by application.
_local_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where the cluster names none (a bare local session, all in one
    process) is a local temporary folder used, one for each application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.get(app) or _local_roots.setdefault(app, tempfile.mkdtemp(prefix="farelake-"))
    return f"{root.rstrip('/')}/farelake/{purpose}-{uuid.uuid4().hex}"


def durable(df, purpose: str):
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage in a way that survives lost executors. The caller uses it
    where a result is read more than once and must be the same each time.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
