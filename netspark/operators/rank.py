"""PageRank, random walk with restart and HITS: one job a step, nothing per vertex on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.functions.clean import guard0
from netspark.operators.graph import Graph, Spread
from netspark.operators.iterate import Loop
from netspark.operators.lookup import lookup_join
from netspark.workspace import Workspace

WHOLE_EDGES = 24 << 20  # so many edges walk in one task: 16 bytes each, 24 where the indexes are long


def _stepped(told: DataFrame, state: DataFrame, *keep: str) -> DataFrame:
    """(idx, y, ``keep``...): what every vertex of ``state`` is told, summed, beside its state.

    One aggregate over both instead of a join back: vertices that nobody tells anything have y = 0.
    """
    nothing = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in keep]
    both = told.select("idx", "y", F.lit(False).alias("own"), *nothing).unionAll(state.select("idx", F.lit(0.0).alias("y"), F.lit(True).alias("own"), *keep))
    return both.groupBy("idx").agg(F.sum("y").alias("y"), F.max("own").alias("own"), *[F.max(c).alias(c) for c in keep]).where("own").drop("own")


def _told(edges: Spread, x: DataFrame, value: str = "x") -> DataFrame:
    return edges.meet(x.select("idx", F.col(value).alias("v"))).select(F.col("dst").alias("idx"), (F.col("weight") * F.col("v")).alias("y"))


def pagerank(g: Graph, damping: float = 0.85, tol: float | None = 1e-6, max_iter: int = 100, *, compat: bool = False) -> DataFrame:
    """(idx, x): weight-proportional PageRank; stops when the L1 change is below ``tol``.

    Dangling vertices (no out-weight) spread their mass evenly. ``compat`` also
    counts vertices whose out-weight is exactly 1 as dangling. ``tol=None`` runs
    ``max_iter`` steps. No vertices give an empty result. A graph of a broadcast
    vector and at most ``WHOLE_EDGES`` edges takes all its steps in one task. In a
    larger one a step is a job that moves partial sums by vertex and the state; the
    edges stay where they are (``Spread``).
    """
    n = g.n
    ws = Workspace(g.edges.sparkSession, "pagerank")
    if g.hot_within(8) is None and isinstance(g.vertices.schema["idx"].dataType, T.IntegerType | T.LongType):
        edges = ws.save(g.edges.select("src", "dst", "weight"), "edges")
        if edges.count() <= WHOLE_EDGES:
            return ws.save(_pagerank_whole(g.vertices, edges, damping, tol, max_iter, compat), "x")
        g = Graph(g.vertices, edges, g.symmetric, g._n, g._hot)
    out = ws.save(g.edges.groupBy("src").agg(F.sum("weight").alias("out")), "out")
    p = Spread(ws, "transitions", _divided(g, out), g.hot)
    no_out = F.coalesce("out", F.lit(0.0)) == 0
    dangling = (no_out | (F.col("out") == 1.0)) if compat else no_out
    start = g.vertices.join(out.withColumnRenamed("src", "idx"), "idx", "left").select("idx", dangling.alias("dangling"), F.lit(1.0 / max(n, 1)).alias("x"))
    loop = Loop(ws, "x")
    loose = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("x"))), F.lit(0.0))
    x, seen = loop.save(start.withColumn("d", F.lit(0.0)), loose=loose)
    for _ in range(max_iter):
        new = F.lit(damping) * F.col("y") + F.lit((1 - damping) / max(n, 1) + damping * seen["loose"] / max(n, 1))
        nxt = _stepped(_told(p, x), x, "dangling", "x").select("idx", "dangling", new.alias("x"), F.abs(new - F.col("x")).alias("d"))
        x, seen = loop.save(nxt, loose=loose, change=F.coalesce(F.sum("d"), F.lit(0.0)))
        if tol is not None and seen["change"] < tol:
            break
    return x.select("idx", "x")


def _pagerank_whole(vertices: DataFrame, edges: DataFrame, damping: float, tol: float | None, max_iter: int, compat: bool) -> DataFrame:
    """``pagerank`` by one task that holds the edges in chunks."""
    kind = vertices.schema["idx"].dataType
    rows = edges.select(F.col("src").cast(kind), F.col("dst").cast(kind), F.col("weight").cast("double")).where("src is not null and dst is not null and weight is not null")
    rows = rows.unionAll(vertices.where("idx is not null").select("idx", F.lit(None).cast(kind), F.lit(None).cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, chunks, few, held = [], [], [], 0
        for b in batches:
            own = b.column("dst").is_null()
            ids.append(b.filter(own).column("src").to_numpy(zero_copy_only=False).copy())
            e = b.filter(pc.invert(own))
            few.append([c.to_numpy(zero_copy_only=False) for c in e.columns])
            held += e.num_rows
            if held >= 1 << 20:
                chunks.append([np.concatenate(c) for c in zip(*few)])
                few, held = [], 0
        if few:
            chunks.append([np.concatenate(c) for c in zip(*few)])
        idx = np.unique(np.concatenate(ids)) if ids else np.zeros(0, "i8")
        n = len(idx)
        if not n:
            return
        out = np.zeros(n + 1)
        for c in chunks:  # indexes become places; an end that is no vertex has place n
            for k in (0, 1):
                at = np.minimum(np.searchsorted(idx, c[k]), n - 1)
                c[k] = np.where(idx[at] == c[k], at, n).astype("i4")
            out += np.bincount(c[0], c[2], n + 1)
        for c in chunks:
            c[2] /= np.where(out == 0, 1.0, out)[c[0]]
        dangling = out[:n] == 0
        if compat:
            dangling |= out[:n] == 1.0
        x = np.append(np.full(n, 1.0 / n), 0.0)
        for _ in range(max_iter):
            new = np.full(n + 1, (1 - damping) / n + damping * x[:n][dangling].sum() / n)
            for src, dst, p in chunks:
                new += damping * np.bincount(dst, p * x[src], n + 1)
            new[n] = 0.0
            change, x = np.abs(new - x).sum(), new
            if tol is not None and change < tol:
                break
        for a in range(0, n, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(idx[a : a + (1 << 16)]), pa.array(x[:n][a : a + (1 << 16)])], names=["idx", "x"])

    return rows.repartition(1).mapInArrow(run, T.StructType([T.StructField("idx", kind), T.StructField("x", T.DoubleType())]))


def _divided(g: Graph, out: DataFrame) -> DataFrame:
    """The edges with weights divided by the out-weight of their source."""
    return lookup_join(g.edges, out, "src", g.hot).select("src", "dst", (F.col("weight") / guard0(F.col("out"))).alias("weight"))


def rwr(g: Graph, seeds: list[int], restart: float = 0.15, tol: float | None = 1e-6, max_iter: int = 100) -> DataFrame:
    """(idx, x): random walk with restart from the distinct seeds, evenly.

    Steps follow column-normalised weights; a seed without edges keeps ``restart``
    of its mass and loses the rest. The walk is linear, so the mean over single
    seeds is this one walk. No seeds is an error.
    """
    seeds = list(dict.fromkeys(int(s) for s in seeds))
    if not seeds:
        raise ValueError("no seeds")
    ws = Workspace(g.edges.sparkSession, "rwr")
    out = ws.save(g.edges.groupBy("src").agg(F.sum("weight").alias("out")), "out")
    w = Spread(ws, "transitions", _divided(g, out), g.hot)
    start = g.vertices.select("idx", F.when(F.col("idx").isin(seeds), F.lit(1.0 / len(seeds))).otherwise(0.0).alias("p0"))
    loop = Loop(ws, "x")
    x, _ = loop.save(start.withColumn("x", F.col("p0")))
    for _ in range(max_iter):
        new = (1 - restart) * F.col("y") + restart * F.col("p0")
        nxt = _stepped(_told(w, x), x, "p0", "x").select("idx", "p0", new.alias("x"), F.abs(new - F.col("x")).alias("d"))
        x, seen = loop.save(nxt, change=F.coalesce(F.sum("d"), F.lit(0.0)))
        if tol is not None and seen["change"] < tol:
            break
    return x.select("idx", "x")


def rwr_each(g: Graph, seeds: list[int], restart: float = 0.15, steps: int = 20) -> DataFrame:
    """(seed, idx, x): one walk per seed, all in one state table keyed by (seed, idx)."""
    ws = Workspace(g.edges.sparkSession, "rwr")
    kind = g.vertices.schema["idx"].dataType
    seeds = list(dict.fromkeys(seeds))
    out = ws.save(g.edges.groupBy("src").agg(F.sum("weight").alias("out")), "out")
    w = Spread(ws, "transitions", _divided(g, out), g.hot_within(64 * len(seeds)))
    loop = Loop(ws, "x")
    listed = F.explode(F.array(*[F.lit(s).cast(kind) for s in seeds]))
    x, _ = loop.save(g.vertices.select("idx", listed.alias("seed")).where("idx = seed").select("seed", "idx", F.lit(1.0).alias("x")))
    home = ws.save(x.select("seed", "idx", F.lit(float(restart)).alias("x")), "home")
    for _ in range(steps):
        moved = w.meet(x).select("seed", F.col("dst").alias("idx"), ((1 - restart) * F.col("x") * F.col("weight")).alias("x"))
        x, _ = loop.save(moved.unionAll(home).groupBy("seed", "idx").agg(F.sum("x").alias("x")))
    return x


def hits(g: Graph, tol: float | None = 1e-6, max_iter: int = 100) -> DataFrame:
    """(idx, hub, authority): both of L2 norm 1; authorities first, hubs from the new ones.

    Stops when neither vector changes anywhere by ``tol`` or more. A vector of
    norm 0 is not scaled.
    """
    ws = Workspace(g.edges.sparkSession, "hits")
    flip = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    forth = Spread(ws, "forth", g.edges.select("src", "dst", "weight"), g.hot)
    back = Spread(ws, "back", flip, Graph(g.vertices, flip, _n=g.n).hot)
    loop = Loop(ws, "x")
    norm = F.coalesce(F.sum(F.col("raw") * F.col("raw")), F.lit(0.0))
    x, _ = loop.save(g.vertices.select("idx", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"), F.lit(2.0).alias("was")))
    gap = float("inf")
    for _ in range(max_iter):
        a = _stepped(_told(forth, x, "hub"), x, "hub", "authority", "was").withColumnRenamed("y", "raw")
        a, seen = loop.save(a, square=norm, moved=F.max(F.abs(F.col("hub") - F.col("was"))))
        if tol is not None and max(gap, seen["moved"] or 0.0) < tol:
            break  # the step before changed nothing; this half step is not taken
        new = F.col("raw") / (seen["square"] ** 0.5 or 1.0)
        a = a.select("idx", F.col("hub").alias("was"), new.alias("authority"), F.abs(new - F.col("authority")).alias("d"))
        h = _stepped(_told(back, a, "authority"), a, "was", "authority", "d").withColumnRenamed("y", "raw")
        h, seen = loop.save(h, square=norm, change=F.coalesce(F.max("d"), F.lit(0.0)))
        gap = seen["change"]
        x = h.select("idx", (F.col("raw") / (seen["square"] ** 0.5 or 1.0)).alias("hub"), "authority", "was")
    return x.select("idx", "hub", "authority")
