"""Two-layer graph convolution, forward pass with seeded weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.graph import Graph
from netspark.operators.lookup import lookup_join
from netspark.workspace import Workspace


def normalised_adjacency(g: Graph) -> DataFrame:
    """(src, dst, weight) of D^-1/2 (A + I) D^-1/2, D the row sums of A + I."""
    loops = g.vertices.select(F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(1.0).alias("weight"))
    a = g.edges.select("src", "dst", "weight").unionAll(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    d = a.groupBy("src").agg(F.sum("weight").alias("d"))
    root = F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("r")
    rs, rd = d.select("src", root), d.select(F.col("src").alias("dst"), root)
    a = lookup_join(a, rs.withColumnRenamed("r", "a"), "src", g.hot)
    return lookup_join(a, rd.withColumnRenamed("r", "b"), "dst", g.hot).select("src", "dst", (F.col("weight") * F.col("a") * F.col("b")).alias("weight"))


def _spmm(adj: DataFrame, h: DataFrame, dims: int, hot: list | None) -> DataFrame:
    """adj @ H for H = (idx, h array): one join and one aggregate of ``dims`` sums."""
    e = lookup_join(adj, h.withColumnRenamed("idx", "src"), "src", hot)
    sums = e.groupBy(F.col("dst").alias("idx")).agg(*[F.sum(F.col("weight") * F.col("h")[i]).alias(f"h{i}") for i in range(dims)])
    return sums.select("idx", F.array(*[f"h{i}" for i in range(dims)]).alias("h"))


def _dense(h: DataFrame, w: np.ndarray, relu: bool) -> DataFrame:
    kind = h.schema["idx"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b):
                y = np.stack(b["h"].to_numpy()) @ w
                yield pd.DataFrame({"idx": b["idx"], "h": list(np.maximum(y, 0) if relu else y)})

    return h.mapInPandas(run, f"idx {kind}, h array<double>")


def gcn(g: Graph, features: DataFrame | None = None, hidden: int = 64, out: int = 32, seed: int = 42, width: int = 16) -> DataFrame:
    """(idx, emb array<double>) of unit length (0 stays 0).

    Without ``features`` (idx, h array<double>) the input of a vertex is one random
    row times its degree to the power -1/2; as that has rank 1 and the adjacency
    no negative entries, all embeddings are then one and the same vector.
    """
    ws = Workspace(g.edges.sparkSession, "gcn")
    rng = np.random.default_rng(seed)
    row = rng.standard_normal((1, width))
    adj = ws.save(normalised_adjacency(g), "adj")
    if features is None:
        d = g.edges.groupBy(F.col("src").alias("idx")).agg(F.sum("weight").alias("d"))
        scale = F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0)
        features = g.vertices.join(d, "idx", "left").select("idx", scale.alias("s")).select("idx", F.array(*[F.col("s") * float(v) for v in row[0]]).alias("h"))
    else:
        width = len(features.first().h)
    w1 = rng.standard_normal((width, hidden)) * np.sqrt(2.0 / (width + hidden))
    w2 = rng.standard_normal((hidden, out)) * np.sqrt(2.0 / (hidden + out))
    h = ws.save(_dense(_spmm(adj, features, width, g.hot_within(16 * width)), w1, True), "h1")
    # A (H W2) = (A H) W2, and H W2 is the narrower table to shuffle
    h = _spmm(adj, _dense(h, w2, False), out, g.hot_within(16 * out))
    size = F.sqrt(F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x))
    return h.withColumn("len", size).select("idx", F.transform("h", lambda x: x / F.when(F.col("len") == 0, 1.0).otherwise(F.col("len"))).alias("emb"))


def wide(embedded: DataFrame, dims: int = 32) -> DataFrame:
    """(idx, dim_0, ...): one column a dimension."""
    return embedded.select("idx", *[F.col("emb")[i].alias(f"dim_{i}") for i in range(dims)])
