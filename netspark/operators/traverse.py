"""Breadth-first hop distances from many sources at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from netspark.operators.graph import Graph, Spread
from netspark.operators.lookup import SMALL_BYTES
from netspark.sources.counts import nth_smallest
from netspark.workspace import Workspace


def random_sources(n: int, k: int = 10, seed: int = 42) -> list[int]:
    """``k`` distinct vertices of 0..n-1, the same for a seed."""
    return [int(x) for x in np.random.default_rng(seed).choice(n, min(k, n), replace=False)]


def source_vertices(vertices: DataFrame, k: int = 10, seed: int = 42) -> list[int]:
    """The vertices at ``random_sources`` positions in the order of their indexes, which need not be dense."""
    n, least, most = vertices.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx")).first()
    at = random_sources(n, k, seed) if n else []
    return at if n and (least, most) == (0, n - 1) else [nth_smallest(vertices, "idx", p) for p in at]


def bfs(g: Graph, sources: list[int], *, direction: str = "out", max_levels: int | None = None) -> DataFrame:
    """(source, idx, dist) for every source and vertex; -1 is unreachable. Weights do not matter.

    One frontier for all sources: a level is one join with the edges and one aggregate
    with the levels before, of which the last two suffice in a symmetric graph. A frontier that was counted as small is broadcast; a larger one is shuffled
    to the edges, which stay where they are (``Spread``). Levels are directories
    ``dist=<level>``, so that all their plans are alike and compiled once. ``direction``
    'in' follows edges backwards. Sources that are no vertices reach nothing and have
    no row of distance 0. Levels end when the frontier is empty.
    """
    spark = g.edges.sparkSession
    ws = Workspace(spark, "bfs")
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    kind = g.vertices.schema["idx"].dataType
    ends = g.edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    step = Spread(ws, "ends", ends, Graph(g.vertices, ends, _n=g.n).hot_within(64 * len(set(sources))))
    key = ["source", "idx"]
    fits = lambda rows: rows * 64 <= SMALL_BYTES
    start = spark.createDataFrame([(int(s),) for s in dict.fromkeys(sources)], "source long").select(F.col("source").cast(kind).alias("source"), F.col("source").cast(kind).alias("idx"))
    saved = [ws.save(start.join(g.vertices, "idx", "left_semi").select(*key), "levels/dist=0")]
    sizes = [saved[0].count()]
    while sizes[-1] and (max_levels is None or len(saved) <= max_levels):
        last = slice(-2, None) if g.symmetric else slice(None)
        known = reduce(DataFrame.unionAll, saved[last]).select(*key, F.lit(True).alias("old"))
        near = step.meet(saved[-1], small=fits(sizes[-1])).select("source", F.col("dst").alias("idx"), F.lit(False).alias("old"))
        o = Observation()
        found = near.unionAll(known).groupBy(*key).agg(F.max("old").alias("old")).where("not old").select(*key).observe(o, F.count(F.lit(1)).alias("n"))
        saved.append(ws.save(found, f"levels/dist={len(saved)}"))
        sizes.append(o.get["n"])
    seen = spark.read.schema(f"source {kind.simpleString()}, idx {kind.simpleString()}, dist int").parquet(ws.at("levels"))
    listed = F.array(*[F.lit(int(s)).cast(kind) for s in dict.fromkeys(sources)])
    grid = g.vertices.select("idx", F.explode(listed).alias("source"))  # the result's own size
    return grid.join(seen, key, "left").select("source", "idx", F.coalesce("dist", F.lit(-1)).alias("dist"))


def bfs_wide(dist: DataFrame, sources: list[int]) -> DataFrame:
    """(idx, dist_from_<source>...): one column a source."""
    return dist.groupBy("idx").agg(*[F.max(F.when(F.col("source") == s, F.col("dist"))).alias(f"dist_from_{s}") for s in sources])


def reachable(dist: DataFrame) -> DataFrame:
    """(source, n): vertices within reach."""
    return dist.groupBy("source").agg(F.count_if(F.col("dist") >= 0).alias("n"))
