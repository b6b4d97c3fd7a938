"""Environment checks: interpreter, Spark, packages, cores, memory and the shared folder."""

from __future__ import annotations

import importlib.util
import platform
import sys

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("pyspark", "numpy", "pandas", "pyarrow")
OPTIONAL = ("tiktoken", "duckdb", "pytest", "hypothesis")


def doctor(spark: SparkSession) -> DataFrame:
    """(check, value, ok): what a run needs and what is there."""
    conf = spark.conf
    rows = [("python", platform.python_version(), sys.version_info >= (3, 10)), ("spark", spark.version, spark.version >= "4")]
    rows += [(f"package {p}", "present" if (ok := importlib.util.find_spec(p) is not None) else "missing", ok) for p in REQUIRED]
    rows += [(f"optional {p}", "present" if importlib.util.find_spec(p) else "missing", True) for p in OPTIONAL]
    rows.append(("cores", str(spark.sparkContext.defaultParallelism), True))
    rows.append(("shuffle partitions", conf.get("spark.sql.shuffle.partitions"), True))
    rows.append(("adaptive execution", conf.get("spark.sql.adaptive.enabled"), conf.get("spark.sql.adaptive.enabled") == "true"))
    shared = conf.get("spark.checkpoint.dir", None)
    rows.append(("spark.checkpoint.dir", shared or "unset", bool(shared) or spark.sparkContext.master.startswith("local")))
    return spark.createDataFrame(rows, "check string, value string, ok boolean")
