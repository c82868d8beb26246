"""Spark session and shared-folder helpers.

Intermediate tables (planner rounds, ranked orders) are written as Parquet
under the folder the cluster names in ``spark.checkpoint.dir``. On a cluster
that folder is shared storage; the library only falls back to a private
temporary folder when the session runs in local mode and nothing is set.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app_name: str = "millrun") -> SparkSession:
    """Session for tests, the bench and scripts (local mode)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRUN_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only when unset in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrun-ckpt-"))
    return sc.getCheckpointDir()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Workers already find it when it is installed or sent with ``--py-files``; this
    adds the driver's folder for sessions that share a file system with it.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def trace(msg: str) -> None:
    """Timing line on stderr when MILLRUN_TRACE is set."""
    if os.environ.get("MILLRUN_TRACE"):
        print(f"[millrun] {msg}", file=sys.stderr)


class Scratch:
    """Unique folder under the checkpoint dir for one job's written tables."""

    def __init__(self, spark: SparkSession, tag: str = "job"):
        self.spark = spark
        root = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{root}/millrun-{tag}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise ``df`` as Parquet and return a fresh scan of it (cuts lineage)."""
        p = self.path(name)
        t0 = time.time()
        df.write.mode("overwrite").parquet(p)
        trace(f"wrote {name} in {time.time() - t0:.2f}s")
        return self.spark.read.schema(df.schema).parquet(p)

    def clear(self) -> None:
        """Delete all tables of this folder; nothing may read them any more."""
        self.drop("")

    def drop(self, name: str) -> None:
        """Delete a written table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
