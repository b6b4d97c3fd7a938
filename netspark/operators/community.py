"""Louvain communities and modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators.graph import Graph, Spread
from netspark.operators.iterate import Loop
from netspark.operators.lookup import hot_keys, lookup_join
from netspark.workspace import Workspace


def modularity(g: Graph, parts: DataFrame) -> DataFrame:
    """(communities, modularity) of (idx, community) on a symmetric graph."""
    c = parts.select("idx", "community")
    e = lookup_join(g.edges, c.select(F.col("idx").alias("src"), F.col("community").alias("cs")), "src", g.hot)
    e = lookup_join(e, c.select(F.col("idx").alias("dst"), F.col("community").alias("cd")), "dst", g.hot)  # symmetric: the same vertices are hot
    per = e.groupBy(F.col("cs").alias("community")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"))
    all_ = c.select("community").distinct().join(per, "community", "left")
    one = all_.agg(F.count(F.lit(1)).alias("communities"), F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return one.select("communities", F.coalesce(F.col("inside") / F.nullif("m2", F.lit(0.0)) - F.col("kk") / F.nullif(F.col("m2") * F.col("m2"), F.lit(0.0)), F.lit(0.0)).alias("modularity"))


def louvain(g: Graph, *, tol: float = 1e-6, seed: int = 0, max_passes: int = 1000) -> DataFrame:
    """(idx, community) by parallel local moving and aggregation, after Blondel et al.

    In a pass a hashed part of the vertices may move, each to the neighbouring
    community of greatest modularity gain (ties to the smaller community), so two
    vertices seldom swap places. The part is a half, less after a pass that lowered the
    modularity, and all of them after one that moved nothing. A level ends when a pass
    in which all may move moves nothing, or when two passes each raised the modularity
    by less than a fiftieth of what the level has gained, or ``tol``; communities then become the vertices of the next level, with
    their inner weight as loops. The levels end when one moves nothing.
    ``max_passes`` is a guard: reaching it is an error, not a result.

    All of it are aggregates and joins on edges and on one-row-a-vertex tables, in
    which small tables are broadcast whole and hot vertices and communities apart.
    """
    spark = g.edges.sparkSession
    ws = Workspace(spark, f"louvain{seed}")
    e = g.edges.select("src", "dst", "weight")
    m2 = e.agg(F.sum("weight")).first()[0] or 0.0
    final = ws.save(g.vertices.select("idx", F.col("idx").alias("community")), "final0")
    if m2 <= 0:
        return final
    level = passes = 0
    while True:
        level += 1
        k = e.groupBy(F.col("src").alias("idx")).agg(F.sum("weight").alias("k"))
        loop = Loop(ws, f"move{level}-")
        state, seen = loop.save(k.select("idx", "k", F.col("idx").alias("c")), n=F.count(F.lit(1)))
        now = Graph(state, e, symmetric=True, _n=seen["n"])
        inner = Spread(ws, f"inner{level}", e.where("src <> dst"), now.hot)
        moved, scores, stall, parts = [], [], 0, 2
        while True:
            tot = state.groupBy("c").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
            hot = None if now.hot is None else hot_keys(tot := ws.save(tot, f"tot{level}-{len(moved)}"), "c", "size", now.n)
            tot = tot.select("c", "tot")
            link = inner.meet(state.select("idx", "c")).groupBy(F.col("dst").alias("v"), "c").agg(F.sum("weight").alias("w"))
            base = state.select(F.col("idx").alias("v"), "k", F.col("c").alias("home"))
            own = lookup_join(base, tot.select(F.col("c").alias("home"), F.col("tot").alias("around")), "home", hot)
            x = lookup_join(lookup_join(link, base, "v", now.hot), tot, "c", hot)
            at_home = F.col("c") == F.col("home")
            gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0)) / m2
            offers = x.withColumn("gain", gain).select("v", F.struct(F.round("gain", 10).alias("gain"), (-F.col("c")).alias("nc")).alias("best"), F.when(at_home, F.struct("gain", "w")).alias("stay"))
            # one aggregate over the offers and the vertices themselves: some have no offers
            offers = offers.unionByName(own, allowMissingColumns=True).groupBy(F.col("v").alias("idx")).agg(*[F.max(c).alias(c) for c in ("best", "stay", "k", "home", "around")])
            alone = -F.col("k") * (F.col("around") - F.col("k")) / m2
            of = 1 if moved and moved[-1] == 0 else parts
            turn = F.pmod(F.xxhash64("idx", F.lit(seed * 1_000_000 + passes)), F.lit(of)) == 0
            go = turn & F.col("best").isNotNull() & (F.col("best.gain") > F.coalesce("stay.gain", alone) + 1e-9)
            # two sums give the modularity before the pass: weight within communities, and k * tot over the vertices
            nxt = offers.select("idx", "k", F.when(go, -F.col("best.nc")).otherwise(F.col("home")).alias("c"), go.alias("go"), F.coalesce("stay.w", F.lit(0.0)).alias("within"), (F.col("k") * F.col("around")).alias("square"))
            state, seen = loop.save(nxt, moved=F.count_if("go"), within=F.sum("within"), square=F.sum("square"))
            state = state.select("idx", "k", "c")
            if hot is not None:
                ws.drop(f"tot{level}-{len(moved)}")
            moved.append(seen["moved"])
            scores.append(seen["within"] / m2 - seen["square"] / m2 / m2)
            rise = scores[-1] - scores[-2] if len(scores) > 1 else 1.0
            if rise < -tol and parts < 8:  # too many moved at once
                parts *= 2
            else:
                stall = stall + 1 if rise < max(tol, (max(scores) - scores[0]) / 50) else 0
            passes += 1
            if passes > max_passes:
                raise RuntimeError(f"modularity still rises after {max_passes} passes")
            if moved[-1] == 0 and of == 1 or stall >= 2:
                break
        if not any(moved):
            break
        at = final.select("idx", F.col("community").alias("at"))
        hot = None if now.hot is None else hot_keys(at.groupBy("at").count(), "at", "count", g.n)
        final = lookup_join(at, state.select(F.col("idx").alias("at"), "c"), "at", hot, "left").select("idx", F.coalesce("c", "at").alias("community"))
        final = ws.save(final, f"final{level}")
        name = state.select("idx", "c")
        e = inner.meet(name).select(F.col("c").alias("src"), "dst", "weight").unionAll(lookup_join(e.where("src = dst").withColumnRenamed("src", "idx"), name, "idx", now.hot).select(F.col("c").alias("src"), "dst", "weight"))
        e = lookup_join(e, name.select(F.col("idx").alias("dst"), "c"), "dst", now.hot).groupBy("src", F.col("c").alias("dst")).agg(F.sum("weight").alias("weight"))
        e = ws.save(e, f"edges{level}")
    return final


def best_louvain(g: Graph, restarts: int = 3, **kw) -> DataFrame:
    """The partition of greatest modularity of several seeds."""
    runs = [louvain(g, seed=s, **kw) for s in range(restarts)]
    return max(runs, key=lambda r: modularity(g, r).first().modularity)
