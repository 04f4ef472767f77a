"""Sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; master and shuffle partitions only where given, so a cluster's own stay."""
    builder = SparkSession.builder.appName("foldspark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
