"""Session defaults for local runs; on a cluster the session comes from outside."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "netspark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and ANSI on (the Spark 4 default)."""
    cpus = cpus or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
