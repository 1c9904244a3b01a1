"""Session set-up."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did (harmless where it is installed)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def session(name: str = "loomgrid", **conf: str) -> SparkSession:
    """A session with the settings the engine is meant for: adaptive execution, UTC, Arrow transfer."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    reachable(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session. Only in local mode, where
    there is one machine, a temporary folder of this process may stand in for it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="loomgrid-")
        atexit.register(shutil.rmtree, local, True)
        root = f"file://{local}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
