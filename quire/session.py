"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "quire", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC times, ANSI arithmetic and adaptive execution.

    On a cluster, pass the master and leave memory and partition sizes to the cluster's own
    configuration; adaptive execution splits skewed joins and merges small partitions there.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
