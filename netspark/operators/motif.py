"""Triangles, wedges and clustering coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.graph import Graph, degrees
from netspark.operators.lookup import lookup_join
from netspark.workspace import Workspace


def triangles(g: Graph, weighted: bool = True) -> DataFrame:
    """(idx, t): half the closed walks of length 3 of a graph without loops, unless 0.

    Each triangle is met once, from its vertex of least (degree, idx): edges point
    from the lesser to the greater, so a hub lists few neighbours and the number
    of candidate wedges stays within E * sqrt(E).
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    ws = Workspace(g.edges.sparkSession, "motif")
    d = ws.save(degrees(g).select("idx", F.struct("degree", "idx").alias("k")), "degrees")
    e = g.edges.where("src <> dst").select("src", "dst", w.alias("w"))
    e = lookup_join(e, d.select(F.col("idx").alias("src"), F.col("k").alias("ks")), "src", g.hot)
    e = lookup_join(e, d.select(F.col("idx").alias("dst"), F.col("k").alias("kd")), "dst", g.hot)  # symmetric: the same vertices are hot
    e = ws.save(e.where("ks < kd").select("src", "dst", "kd", "w"), "oriented")
    a = e.select("src", F.col("dst").alias("b"), F.col("kd").alias("kb"), F.col("w").alias("wb"))
    c = e.select("src", F.col("dst").alias("c"), F.col("kd").alias("kc"), F.col("w").alias("wc"))
    wedge = a.join(c, "src").where("kb < kc").select("src", "b", "c", (F.col("wb") * F.col("wc")).alias("p"))
    tri = wedge.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c"), "w"), ["b", "c"])
    return tri.select(F.explode(F.array("src", "b", "c")).alias("idx"), (F.col("p") * F.col("w")).alias("t")).groupBy("idx").agg(F.sum("t").alias("t"))


def motifs(g: Graph, weighted: bool = True) -> DataFrame:
    """(idx, triangles, clustering_coeff, degree) of every vertex.

    Weighted: triangles and degree are weight products and sums cut to whole
    numbers, wedges come from the uncut weighted degree, and the coefficient is
    cut to [0, 1]. Unweighted: true counts.
    """
    d = degrees(g).select("idx", (F.col("weighted_degree") if weighted else F.col("degree").cast("double")).alias("d"))
    wedges = F.col("d") * (F.col("d") - 1) / 2
    t = F.coalesce("t", F.lit(0.0))
    out = d.join(triangles(g, weighted), "idx", "left")
    return out.select("idx", t.cast("long").alias("triangles"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t / F.when(wedges == 0, 1.0).otherwise(wedges))).alias("clustering_coeff"), F.col("d").cast("int").alias("degree"))


def motif_totals(per_vertex: DataFrame) -> DataFrame:
    """(total_triangles, avg_clustering) over all vertices."""
    return per_vertex.agg(F.expr("sum(triangles) div 3").alias("total_triangles"), F.avg("clustering_coeff").alias("avg_clustering"))
