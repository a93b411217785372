"""Session settings the operators rely on.

Everything is a runtime SQL setting, so an existing cluster session can be
tuned with :func:`tune` and keeps whatever its operator set explicitly.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings and why each one is wanted.
RUNTIME_CONF = {
    # Timestamps are whole-UTC; the driver tables carry TIMESTAMP_NTZ.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is cut into several tasks even when an aggregate over the
    # same key follows; Spark then re-shuffles the (already combined) partials.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to ``spark`` and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app_name: str = "venuedir") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is missing, a local session (tests) gets a temporary folder;
    a cluster has to name one, because its machines share no local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = _local_dir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="venuedir-"))
    return _LOCAL[0]
