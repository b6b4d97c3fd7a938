"""Co-expression edges: all-pairs correlation of z-scores above a threshold.

The weight is ``sum(z z') / (S - 1)`` of z-scores by the population deviation,
that is r * S / (S - 1); it may exceed 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions.clean import usable
from netspark.workspace import Workspace


def edges_by_join(z: DataFrame, n_samples: int, threshold: float = 0.7) -> DataFrame:
    """(src, dst, weight), src < dst: as a self-join on the sample. For few genes and samples."""
    z = z.where(usable("z"))
    a, b = z.select(F.col("gene").alias("src"), "sample", F.col("z").alias("za")), z.select(F.col("gene").alias("dst"), "sample", F.col("z").alias("zb"))
    r = a.join(b, "sample").where("src < dst").groupBy("src", "dst").agg((F.sum(F.col("za") * F.col("zb")) / (n_samples - 1)).alias("weight"))
    return r.where(F.col("weight") >= threshold)


def _block_rows(genes: int, samples: int) -> int:
    """Genes of a block: two blocks and their product stay below about 0.4 GB, and there are a hundred tasks if there are genes for them."""
    return max(256, min(4096, (1 << 28) // (16 * max(1, samples)), -(-genes // 16)))


def edges_by_blocks(z: DataFrame, n_samples: int, threshold: float = 0.7, block: int | None = None) -> DataFrame:
    """The same edges from block products, for many genes or samples.

    Genes are folded into vectors over the sample axis and vectors into blocks by
    hash. Each block meets every block of greater or equal number once, in a task
    of its own, as one matrix product; only edges above the threshold leave it. A
    task holds two blocks. The pairs of blocks are listed by an equi-join on the
    block number, so data moves blocks-times, not pairs-times. A sample that a gene
    lacks, or has as NULL or NaN, adds nothing to its products, as in the join.
    """
    kind = z.schema["gene"].dataType.simpleString()
    z = z.where(usable("z"))
    axis = z.select("sample").distinct().withColumn("pos", F.row_number().over(Window.orderBy("sample")) - 1)  # one row a sample
    axis = Workspace(z.sparkSession, "axis").save(axis, "axis")
    samples = axis.count()
    vec = z.join(axis, "sample").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("x"))
    at = F.when(F.size("x") < samples, F.transform("x", lambda e: e["pos"]))  # NULL where no sample is missing
    vec = Workspace(z.sparkSession, "vectors").save(vec.select("gene", at.alias("at"), F.transform("x", lambda e: e["z"]).alias("v")), "v")
    n = vec.count()
    blocks = max(1, -(-n // (block or _block_rows(n, samples))))
    vec = vec.withColumn("b", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    # block b is the left side of tasks (b, j >= b) and the right side of tasks (i < b, b)
    left = vec.select("gene", "at", "v", F.lit(0).alias("side"), F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("j"))
    right = vec.where("b > 0").select("gene", "at", "v", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), F.col("b").alias("j"))

    def dense(g: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(g), samples))
        for row, at, v in zip(m, g["at"], g["v"]):
            row[slice(None) if at is None else np.asarray(at)] = v
        return m

    def multiply(g: pd.DataFrame) -> pd.DataFrame:
        a = g[g["side"] == 0]
        b = a if g["i"].iat[0] == g["j"].iat[0] else g[g["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"src": a["gene"].iloc[:0], "dst": a["gene"].iloc[:0], "weight": pd.Series(dtype="f8")})
        x = dense(a)
        r = x @ (x if b is a else dense(b)).T / (n_samples - 1)
        x, y = np.nonzero(r >= threshold)
        s, t = a["gene"].to_numpy()[x], b["gene"].to_numpy()[y]
        keep = s < t if b is a else s != t
        s, t, w = s[keep], t[keep], r[x, y][keep]
        low = s < t
        return pd.DataFrame({"src": np.where(low, s, t), "dst": np.where(low, t, s), "weight": w})

    return left.unionAll(right).groupBy("i", "j").applyInPandas(multiply, f"src {kind}, dst {kind}, weight double")


def coexpr_edges(z: DataFrame, n_samples: int, threshold: float = 0.7, *, join_limit: int = 5_000_000) -> DataFrame:
    """By join while the product table has at most ``join_limit`` rows, else by blocks.

    Both give the same edges, also where samples are missing: the sum goes over the
    samples that both genes have. Only the cost differs.
    """
    genes = z.select("gene").distinct().count()
    return (edges_by_join if genes * genes * n_samples / 2 <= join_limit else edges_by_blocks)(z, n_samples, threshold)


def vectors_to_long(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(gene, sample, value) of array columns; missing elements are left out."""
    return df.select(F.col(ident).alias("gene"), F.posexplode(vector).alias("sample", "x")).select("gene", "sample", F.col("x").cast("double").alias("value")).where("value is not null and not isnan(value)")


