"""Expression matrices in long form (gene, sample, value): library sizes to z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions.clean import guard0


def library_sizes(long: DataFrame) -> DataFrame:
    """(sample, lib_size): the sum of counts per sample, 0 replaced by 1."""
    s = long.groupBy("sample").agg(F.sum("value").alias("t"))
    return s.select("sample", guard0(F.coalesce("t", F.lit(0.0))).alias("lib_size"))


def cpm(long: DataFrame, libs: DataFrame | None = None) -> DataFrame:
    """(gene, sample, cpm): counts per million of the sample's library."""
    return long.join(libs if libs is not None else library_sizes(long), "sample").select("gene", "sample", (F.col("value") / F.col("lib_size") * 1e6).alias("cpm"))


def kept_genes(cpms: DataFrame, cpm_threshold: float = 1.0, min_samples_frac: float = 0.2, n_samples: int | None = None) -> DataFrame:
    """(gene, n_expressed) of genes with ``int(frac * samples)`` samples at the threshold; 0 keeps all."""
    s = n_samples if n_samples is not None else cpms.select("sample").distinct().count()
    n = cpms.groupBy("gene").agg(F.count_if(F.col("cpm") >= cpm_threshold).alias("n_expressed"))
    return n.where(F.col("n_expressed") >= int(min_samples_frac * s))


def log2_cpm(cpms: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(gene, sample, value): log2(cpm + 1), of the kept genes only if given."""
    x = cpms if kept is None else cpms.join(kept.select("gene"), "gene", "left_semi")
    return x.select("gene", "sample", F.log2(F.col("cpm") + 1).alias("value"))


def zscore(long: DataFrame) -> DataFrame:
    """(gene, sample, z): by the population deviation; a constant gene has z = 0.

    Mean and deviation come from one aggregate, joined back on the gene: a gene
    with a row per sample is never gathered in a window of one task.
    """
    m = long.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return long.join(m, "gene").select("gene", "sample", ((F.col("value") - F.col("m")) / guard0(F.col("sd"))).alias("z"))
