"""Session helpers: a tuned local/cluster session and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HDFS_PROVIDER = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"

# Settings the operators rely on. AQE re-plans joins from runtime sizes, splits
# skewed shuffle partitions and coalesces small ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # streaming state (dedup keys, open windows) off-heap, spilling to local disk
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sendscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system (HDFS, S3, ...) and
    must be set. Only a local master falls back to a scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = os.path.join(os.environ.get("TMPDIR", "/tmp"), "sendscope-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (stream checkpoints, tables)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/sendscope/{name}-{uuid.uuid4().hex}"


def prefer_rocksdb_state(spark: SparkSession) -> None:
    """Use the RocksDB state store for new streaming queries when the session
    still has the heap-based default (state for hot or long-lived keys must not
    live on the JVM heap). A query restarted from an existing checkpoint keeps
    the provider it was started with."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", HDFS_PROVIDER) == HDFS_PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def scale_conf(shuffle_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings for a cluster run whose largest shuffle moves
    ``shuffle_bytes`` (after projection and map-side aggregation).

    Shuffle partitions start at ~``target_partition_bytes`` each so no reducer
    must spill heavily; AQE then coalesces small ones and splits skewed ones.
    Broadcasts stay capped well below executor memory — every broadcast in
    this library is of a proven-small parameter table or a runtime-measured
    side chosen by AQE.
    """
    n = int(max(200, -(-shuffle_bytes // target_partition_bytes)))
    mb = max(64, target_partition_bytes >> 20)
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{mb}m",
        "spark.sql.files.maxPartitionBytes": f"{mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * mb}m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    }
