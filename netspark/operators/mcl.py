"""Markov clustering on sparse (row, col, val) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions.clean import guard0
from netspark.operators.graph import Graph
from netspark.operators.iterate import Loop
from netspark.operators.linalg import normalise, spgemm, sums_by
from netspark.operators.lookup import lookup_join
from netspark.workspace import Workspace


def mcl_start(g: Graph) -> DataFrame:
    """The column-stochastic matrix of the graph with a self-loop of 1 added to every vertex."""
    loops = g.vertices.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(1.0).alias("val"))
    m = g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("val")).unionAll(loops)
    m = Workspace(g.edges.sparkSession, "mcl").save(m.groupBy("row", "col").agg(F.sum("val").alias("val")), "looped")
    return normalise(m, "col")


def mcl_step(m: DataFrame, expansion: int = 2, inflation: float = 2.0, prune: float = 1e-4, ws: Workspace | None = None) -> DataFrame:
    """Expand by the true matrix power, inflate, normalise, prune below ``prune``, normalise.

    The inflated power is written once; both column sums come from scans of it. A
    matrix that is used several times must be a written table.
    """
    ws = ws or Workspace(m.sparkSession, "mcl")
    x = m
    for i in range(expansion - 1):
        x = ws.save(spgemm(x, m).withColumn("val", F.pow("val", F.lit(float(inflation)))) if i == expansion - 2 else spgemm(x, m), f"power{i}")
    if expansion == 1:
        x = x.withColumn("val", F.pow("val", F.lit(float(inflation))))
    s, hot = sums_by(x, "col")
    kept = lookup_join(x, s, "col", hot).withColumn("val", F.col("val") / guard0(F.col("s"))).where(F.col("val") >= prune).select("row", "col", "val")
    left, hot = sums_by(kept, "col")
    return lookup_join(kept, left, "col", hot).select("row", "col", (F.col("val") / guard0(F.col("s"))).alias("val"))


def mcl(g: Graph, expansion: int = 2, inflation: float = 2.0, prune: float = 1e-4, max_iter: int = 100, tol: float | None = 1e-5) -> DataFrame:
    """The limit matrix over all vertices. To bound the fill-in of the powers, pass a
    ``top_subgraph``, and its vertices to ``mcl_clusters``."""
    ws = Workspace(g.edges.sparkSession, "mcl")
    loop = Loop(ws, "m")
    m, _ = loop.save(mcl_start(g))
    for _ in range(max_iter):
        old = m
        m, _ = loop.save(mcl_step(m, expansion, inflation, prune, ws))
        if tol is not None:
            gap = m.join(old.withColumnRenamed("val", "was"), ["row", "col"], "full").agg(F.max(F.abs(F.coalesce("val", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
            if gap is None or gap < tol:
                break
    return m


def mcl_clusters(m: DataFrame, vertices: DataFrame) -> DataFrame:
    """(idx, community): the attractor of greatest value in the vertex's column, the
    least on ties; attractors have more than 0.01 on the diagonal. A vertex whose
    column reaches none belongs to the first attractor, or to itself if none exists."""
    att = m.where("row = col and val > 0.01").select("row")
    best = m.join(att, "row", "left_semi").groupBy(F.col("col").alias("idx")).agg((-F.max(F.struct("val", (-F.col("row")).alias("r")))["r"]).alias("community"))
    first = att.agg(F.min("row")).first()[0]
    return vertices.join(best, "idx", "left").select("idx", F.coalesce("community", F.lit(first).cast(vertices.schema["idx"].dataType), "idx").alias("community"))
