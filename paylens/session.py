"""Spark session defaults and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on; everything else is the cluster's business.
DEFAULT_CONF = {
    # All timestamps are TIMESTAMP_NTZ; UTC keeps any LTZ conversion neutral.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, switch joins to broadcast from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python call-site capture for error messages costs a JVM round trip per
    # column function while a plan is built; the library builds large plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "paylens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the library defaults.

    ``master``/``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them ``None`` so the submitted configuration wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if master:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Only when neither is set and the master is local — tests — a fresh folder
    under the system temp directory is created and registered; on a cluster a
    folder of one machine would lose rows, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="paylens-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        try:  # core confs may be read-only at runtime; the context setting is what counts
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001
            pass
    return d.rstrip("/")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below :func:`shared_dir` (string join keeps URIs intact)."""
    return "/".join([shared_dir(spark), *parts])


def unique_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared dir for one write (never reused)."""
    base = shared_dir(spark)
    if "://" not in base or base.startswith("file:"):
        local = base[len("file:"):] if base.startswith("file:") else base
        os.makedirs(local, exist_ok=True)
        return tempfile.mkdtemp(prefix=f"{name}-", dir=local)
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex}"
