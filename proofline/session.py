"""Session settings and the scratch area shared by every executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings only: a cluster keeps its own partition counts and memory.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Longer scratch writes can be re-read after an executor is lost: the folder is
# the one the cluster names, never a disk of one machine.
CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_folder: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators are planned for."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, app: str = "proofline") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    cores = str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PROOFLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder of the session.

    Only a `local[...]` session with no such folder (tests, one machine) gets a temporary one, removed at its end.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root and spark.sparkContext.getCheckpointDir():
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="proofline-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        root = _own_folder[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
