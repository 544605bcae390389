"""Spark session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_DIR: str | None = None
_SHIPPED: set[str] = set()


def build_session(
    master: str | None = None,
    app_name: str = "zonepulse",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    AQE stays on: it coalesces the many tiny post-aggregation partitions,
    converts joins against small aggregates into broadcast joins after the
    real size is known, and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is. Only in
    local mode, where driver and executors are one process on one machine,
    an unset folder is replaced by a private temporary one; anywhere else an
    unset folder is an error, because a machine-local path would be another
    folder on each executor.
    """
    global _LOCAL_CHECKPOINT_DIR
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = sc.getCheckpointDir()
        if current:
            return current
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        if _LOCAL_CHECKPOINT_DIR is None:
            _LOCAL_CHECKPOINT_DIR = tempfile.mkdtemp(prefix="zonepulse-ckpt-")
        configured = _LOCAL_CHECKPOINT_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (``addPyFile``), once per application.

    Functions that run in tasks are pickled by reference, so the workers must
    be able to import the package even where it is not installed.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    handle, target = tempfile.mkstemp(prefix="zonepulse-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    The lineage ends there: a lost executor never replays the plan behind it,
    and filters and column choices of later plans reach the written table.
    """
    path = shared_path(df.sparkSession, "tables", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
