"""Session construction and shared-folder discovery."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vellum") -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    Time zone is pinned to UTC so that timestamp text and day buckets are
    stable; AQE is on so joins can switch to broadcast on measured sizes and
    skewed shuffle partitions get split.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The folder comes from ``spark.checkpoint.dir`` (or the SparkContext's
    checkpoint dir).  Only when neither is set -- local tests -- do we set one
    ourselves, under the system temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="vellum-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    sub = f"{name or 'run'}-{uuid.uuid4().hex[:12]}"
    return base.rstrip("/") + "/" + sub


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so the path can be used by Python IO in tests."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path) if not path.startswith("/") else path
