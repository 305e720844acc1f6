"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution does the run-time part of the skew work: it splits a hot join
# partition and merges tiny shuffle partitions.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state lives on local disk with a changelog in the checkpoint folder, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "sparkveil", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = {"spark.sql.session.timeZone": "UTC", **RUNTIME_CONF, **conf}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Fill in runtime settings a session built elsewhere has left unset."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: `spark.checkpoint.dir` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base and context.getCheckpointDir():
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="sparkveil-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark)}/sparkveil/{label}-{uuid.uuid4().hex}"
