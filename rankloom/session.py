"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings we want on every session. They are only applied when the cluster
# (spark-defaults / spark-submit) has not set them already.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rankloom") -> SparkSession:
    """Get or create a session; local callers (tests, bench) pass ``master``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEM", "8g"))
    cluster = SparkConf()  # what spark-submit / spark-defaults already set
    for k, v in _DEFAULTS.items():
        if not cluster.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment and must be on shared
    storage. Where nothing is configured, a single-process (``local[...]``)
    session gets a scratch folder; any other master is refused, because each
    node would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rankloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def table_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(df, name: str = "intermediate"):
    """Write an intermediate that several branches reuse as a parquet table in
    the shared checkpoint folder and read it back. One computation (a plain
    ``checkpoint()`` would compute the plan twice), lineage cut, so a lost
    executor recomputes from the table, not from the raw inputs."""
    import uuid
    path = table_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
