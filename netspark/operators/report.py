"""Comparison of running times: speed-ups, efficiencies, three-way ratios."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def speedup_report(single: DataFrame, parallel: DataFrame, workers: int = 8) -> DataFrame:
    """(algorithm, single_time_s, parallel_time_s, speedup_x, efficiency_pct) of (algorithm, seconds) tables.

    Full outer on the algorithm. The efficiency comes from the rounded speed-up;
    rounding is half-even.
    """
    j = single.withColumnRenamed("seconds", "single_time_s").join(parallel.withColumnRenamed("seconds", "parallel_time_s"), "algorithm", "full")
    j = j.withColumn("speedup_x", F.bround(F.col("single_time_s") / F.nullif("parallel_time_s", F.lit(0.0)), 3))
    return j.withColumn("efficiency_pct", F.bround(F.col("speedup_x") / workers * 100, 1))


def three_way_report(gpu: DataFrame, single: DataFrame, parallel: DataFrame) -> DataFrame:
    """(algorithm, gpu_time_s, single_time_s, parallel_time_s, gpu_vs_single, gpu_vs_parallel)."""
    j = gpu.withColumnRenamed("seconds", "gpu_time_s").join(single.withColumnRenamed("seconds", "single_time_s"), "algorithm", "full").join(parallel.withColumnRenamed("seconds", "parallel_time_s"), "algorithm", "full")
    by = F.nullif("gpu_time_s", F.lit(0.0))
    return j.withColumns({"gpu_vs_single": F.bround(F.col("single_time_s") / by, 2), "gpu_vs_parallel": F.bround(F.col("parallel_time_s") / by, 2)})


def report_totals(report: DataFrame) -> DataFrame:
    """Totals over algorithms timed on both sides, the overall and the mean speed-up, the mean efficiency."""
    both = F.col("single_time_s").isNotNull() & F.col("parallel_time_s").isNotNull()
    t = report.agg(F.sum(F.when(both, F.col("single_time_s"))).alias("total_single"), F.sum(F.when(both, F.col("parallel_time_s"))).alias("total_parallel"), F.avg("speedup_x").alias("mean_speedup"), F.avg("efficiency_pct").alias("mean_efficiency"))
    return t.withColumn("overall_speedup", F.col("total_single") / F.nullif("total_parallel", F.lit(0.0)))


def printed(report: DataFrame) -> DataFrame:
    """The report as text: N/A for missing figures, x and % behind ratios."""
    s = lambda c, f: F.coalesce(F.format_string(f, F.col(c)), F.lit("N/A")) if c else None
    text = {c: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(s(c, "%.4f" if c.endswith("_s") else "%.2f%%" if c.endswith("_pct") else "%.2fx")) for c in report.columns if c != "algorithm"}
    return report.withColumns(text)


def own_report(seconds: DataFrame) -> DataFrame:
    """(algorithm, parallel_time_s): the report where no baseline is given."""
    return seconds.select("algorithm", F.col("seconds").alias("parallel_time_s")).orderBy("algorithm")


def read_seconds(spark: SparkSession, path: str) -> DataFrame:
    """(algorithm, seconds) of a CSV of two columns, whatever their names."""
    return spark.read.csv(path, header=True).toDF("algorithm", "seconds").select("algorithm", F.col("seconds").cast("double").alias("seconds"))


def timed(make: Callable[[], DataFrame], path: str) -> tuple[DataFrame, float]:
    """A result written to ``path`` and the seconds it took, the writing included: it is computed once."""
    t = time.perf_counter()
    df = make()
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), time.perf_counter() - t
