"""Session helpers.

The library never creates a session on its own; these helpers are for tests,
the bench and command-line use. On a cluster the caller's session and its
``spark.checkpoint.dir`` are used as they are.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # files of a checkpoint go when no plan refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "shelfcast", extra: dict | None = None) -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SHELFCAST_MASTER", "local[8]"))
    conf = dict(_BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session in which it is unset (tests, bench) gets a scratch
    folder; on a cluster, where a machine-local folder would not be shared, an
    unset one is an error.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    context.setCheckpointDir(current)
    return current
