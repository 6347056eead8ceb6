"""Session settings for jobs and tests that own their session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and skew handling on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # of a key that a JSON object repeats the last value counts
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_all_cores(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan out evenly when it has too few splits to keep the cores busy.

    For compute-heavy work on small inputs, or on formats read by one task per file. A scan with at
    least half as many splits as there are cores is returned as it is. Only pass plain scans: counting
    the splits of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if 2 * scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
