"""Weighted graphs as two tables: vertices (idx) and edges (src, dst, weight)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions.clean import usable
from netspark.operators.lookup import SMALL_BYTES, hot_keys
from netspark.workspace import Workspace


@dataclass
class Graph:
    """Directed rows; an undirected graph holds both directions and is ``symmetric``."""

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False
    _n: int | None = None
    _hot: list | None = field(default=None, repr=False)

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.vertices.count()
        return self._n

    @property
    def hot_list(self) -> list:
        """Sources that hold a large share of the edges: a bounded list."""
        if self._hot is None:
            self._hot = hot_keys(self.edges.groupBy("src").count(), "src", "count", self.edges.count())
        return self._hot

    def hot_within(self, row_bytes: int) -> list | None:
        """For ``lookup_join``: None if a row a vertex of so many bytes is small, else the hot sources."""
        return None if self.n * row_bytes <= SMALL_BYTES else self.hot_list

    @property
    def hot(self) -> list | None:
        """``hot_within`` for a few numbers a vertex."""
        return self.hot_within(64)


class Spread:
    """Edges kept for many joins with vectors of their sources, without moving the edges again.

    A small vector is broadcast. For larger ones the edges lie bucketed by their
    source, so that only the vector moves; edges of hot sources lie apart and meet
    a broadcast of the vector's rows for those.
    """

    def __init__(self, ws: Workspace, name: str, edges: DataFrame, hot: list | None):
        self.hot = hot
        if hot is None:
            self.cold, self.apart = ws.save(edges, name), None
            return
        buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        is_hot = F.col("src").isin(hot)
        self.cold = ws.save_bucketed(edges.where(~is_hot), name, "src", buckets)
        self.apart = ws.save(edges.where(is_hot), f"{name}-hot") if hot else None

    def meet(self, vec: DataFrame, small: bool | None = None) -> DataFrame:
        """The edges with the columns of ``vec`` (``idx``, ...) for their source; ``small``: the
        caller counted that ``vec`` may be broadcast (by default as given by ``hot``)."""
        v = vec.withColumnRenamed("idx", "src")
        if self.hot is None and small is not False or small:
            out = self.cold.join(F.broadcast(v), "src")
            return out if self.apart is None else out.unionByName(self.apart.join(F.broadcast(v), "src"))
        if self.apart is None:
            return self.cold.join(v, "src")
        is_hot = F.col("src").isin(self.hot)
        return self.cold.join(v.where(~is_hot), "src").unionByName(self.apart.join(F.broadcast(v.where(is_hot)), "src"))


def clean_edges(raw: DataFrame, version: tuple[str, ...] = ("computed_at", "loaded_at")) -> DataFrame:
    """(src, dst, weight), src < dst: the last usable weight of every unordered pair.

    Rows with a NULL end, a NULL or NaN weight, or equal ends are no edges.
    """
    ok = raw.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & usable("weight") & (F.col("src") != F.col("dst")))
    row = F.max(F.struct(*version, F.col("weight").cast("double").alias("weight")))
    return ok.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(row.alias("r")).select("src", "dst", F.col("r.weight").alias("weight"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; weights of equal (src, dst) add up, zeros go."""
    both = F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    e = edges.select(F.explode(both).alias("e")).select("e.*")
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def vertices_of(edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(idx): all ends, and the indexes of ``more``."""
    v = edges.select(F.explode(F.array("src", "dst")).alias("idx"))
    return (v if more is None else v.unionAll(more.select("idx"))).where("idx is not null").distinct()


def degrees(g: Graph) -> DataFrame:
    """(idx, degree, weighted_degree) of every vertex, 0 for isolated ones."""
    d = g.edges.groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    return g.vertices.join(d, "idx", "left").select("idx", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))


def graph_stats(g: Graph) -> DataFrame:
    """One row: nodes, stored and unique edges, density, average and greatest weighted degree, isolated."""
    d = degrees(g).agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("nnz"), F.avg("weighted_degree").alias("avg_degree"), F.max("weighted_degree").alias("max_degree"), F.count_if(F.col("weighted_degree") == 0).alias("isolated"))
    return d.select("nodes", "nnz", F.expr("nnz div 2").alias("unique_edges"), (F.col("nnz") / (F.col("nodes") * F.col("nodes"))).alias("density"), "avg_degree", "max_degree", "isolated")


def top_subgraph(g: Graph, n: int) -> tuple[Graph, DataFrame]:
    """The subgraph induced by the ``n`` vertices of greatest weighted degree, and (idx, pos).

    Ties go to the smaller index. Positions are dense, in order of the index.
    """
    top = degrees(g).orderBy(F.desc("weighted_degree"), "idx").limit(n).select("idx")
    pos = top.withColumn("pos", F.row_number().over(Window.orderBy("idx")) - 1)  # at most n rows
    e = g.edges.join(top.select(F.col("idx").alias("src")), "src", "left_semi").join(top.select(F.col("idx").alias("dst")), "dst", "left_semi")
    return Graph(top, e.select("src", "dst", "weight")), pos
