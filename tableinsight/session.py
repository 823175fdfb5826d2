"""Session settings and the shared folder every durable intermediate goes to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_TARGET_PARTITION_BYTES = 128 * 1024 * 1024

# Adaptive execution decides join sides, partition counts and skew splits from measured sizes.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    """Partitions of about 128 MB, never fewer than the cores; AQE merges the small ones."""
    return max(cores, -(-input_bytes // _TARGET_PARTITION_BYTES))


def build_session(
    app: str = "tableinsight",
    master: str | None = None,
    input_bytes: int | None = None,
    cores: int = 8,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(ADAPTIVE_CONF)
    if input_bytes is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(input_bytes, cores))
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":  # nor in the processes of local-cluster
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tableinsight-")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
