"""Session defaults and the shared work folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every job here relies on; a cluster profile may raise the sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join may split even when that costs the aggregate above it a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a Python worker holds a few copies of a batch, so batches are bounded by their bytes as well as by their rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # the JVM never compiles a method over 8000 bytes: steps fused beyond that run apart, as methods that are compiled
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # keyed state with timers and expiry needs this store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable defaults to an existing session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for stream checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests) a
    folder below the session's warehouse is used, which every executor shares too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_ledgerlens_work"
    return configured.rstrip("/")
