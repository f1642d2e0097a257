"""Session settings every operator relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings results depend on: naive timestamps everywhere, truncations done
# in UTC (no daylight-saving gaps).  Always applied.
SQL_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

# Execution settings the library is tuned for.  All are runtime-settable, so
# they can be applied to a session someone else built (the driver's, a
# notebook's); a value the owner of the session set explicitly is kept.
SQL_DEFAULTS = {
    # Adaptive execution: coalesce small shuffle partitions, split skewed
    # join partitions (activity is heavy-tailed per user), even when the
    # split needs an extra exchange for the aggregate that follows the join.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcasts happen only behind a proven bound: explicit ones after a
    # row-count check (operators.joins) or of fixed-size literal relations,
    # and adaptive ones decided from measured shuffle sizes.  The static
    # planner's file-size estimates (compressed bytes) are not trusted.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}

# Static settings: only a session we build can take them.
STATIC_DEFAULTS = {
    # Python call-site capture costs four JVM round trips per column function
    # while plans are built; error messages lose only the Python line.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    for key, value in SQL_REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.get(key, None) is None:      # not set explicitly
            try:
                spark.conf.set(key, value)
            except Exception:  # noqa: BLE001  (a setting the session does not allow)
                pass
    return spark


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tidemark", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster use the cluster's builder and call
    :func:`apply_defaults` instead."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        **SQL_DEFAULTS,
        **STATIC_DEFAULTS,
        **SQL_REQUIRED,
        **(extra or {}),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_defaults(spark)


_OWN_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset (local runs, tests) do we pick one of our own, a
    local temporary folder -- never the case on a cluster, which names a
    shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        app = spark.sparkContext.applicationId
        root = _OWN_ROOTS.get(app)
        if root is None:
            root = _OWN_ROOTS[app] = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the checkpoint root (never reused)."""
    root = checkpoint_root(spark)
    return f"{root}/tidemark/{name}-{uuid.uuid4().hex[:12]}"

