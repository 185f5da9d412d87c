"""Session settings and the shared scratch folder.

``spark.checkpoint.dir`` names the cluster's shared folder; intermediate
tables are written under it. It is read from the session and only set here
when it is unset *and* Spark runs in local mode (tests, benchmarks): a
machine-local folder is never used on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the engine relies on. AQE re-plans joins from real
# sizes (a small side becomes a broadcast only when it is measured small)
# and splits skewed join partitions even when that costs one extra shuffle.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # stored events keep their buckets below a union too, so a fold of them needs no shuffle
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


def apply_engine_conf(spark: SparkSession) -> None:
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "cohortlab") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    scratch = tempfile.mkdtemp(prefix="cohortlab-")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COHORTLAB_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoint"))
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; set it to a folder every executor can reach"
            )
        # a local session made elsewhere without one: driver and executors are
        # one process here, so a fresh folder on this machine is shared by all
        root = tempfile.mkdtemp(prefix="cohortlab-checkpoint-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
