"""Consolidating pairwise matches into groups: seed-tree pruning.

After Lulli et al., "Fast Connected Components Computation in Large Graphs by
Vertex Pruning". A round has two steps. Selection: every vertex tells itself and
its neighbours the least vertex of its neighbourhood. Pruning: a vertex links the
minima it was told to the least of them; a vertex that nobody chose as minimum
leaves the graph and becomes a child of that least one in the propagation forest;
a vertex that is left without edges is the seed of its component. When no edges
are left, the seeds' identifiers flow down the forest, last pruned layer first.

The order of the vertices in which minima are taken is a hashed one. In the order
of the identifiers themselves a long sorted chain would lose no vertex for many
rounds while its links double in each; in a hashed order a constant share of any
chain drops out per round. The least identifier of a component is found at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.operators.lookup import hot_keys, lookup_join
from netspark.workspace import Workspace


def _both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) as directed ones (u, v), from a single scan."""
    pair = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.explode(pair).alias("e")).select("e.u", "e.v")


def _labels(kind: T.DataType):
    """Label of an identifier in the hashed order, and the identifier of a label.

    A 32-bit identifier becomes a long with hashed upper and its own lower half; a
    64-bit one goes through three Feistel rounds, which permute the longs; any other
    type is its text behind 16 hexadecimal digits of its hash. No two share a label.
    """
    low = F.lit(0xFFFFFFFF)

    def half(c: Column) -> Column:  # the lower 32 bits as a signed integer
        return F.shiftright(F.shiftleft(c, 32), 32).cast("int")

    def joined(high: Column, lower: Column) -> Column:
        return F.shiftleft(high.cast("long"), 32).bitwiseOR(lower.cast("long").bitwiseAND(low))

    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return (lambda c: joined(F.hash(c), c)), (lambda c: half(c).cast(kind))
    if isinstance(kind, T.LongType):

        def name(c: Column) -> Column:
            a, b = F.shiftright(c, 32).cast("int"), half(c)
            for _ in range(3):
                a, b = b, a.bitwiseXOR(F.hash(b))
            return joined(a, b)

        def back(c: Column) -> Column:
            a, b = F.shiftright(c, 32).cast("int"), half(c)
            for _ in range(3):
                a, b = b.bitwiseXOR(F.hash(a)), a
            return joined(a, b)

        return name, back
    return (lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), c.cast("string"))), (lambda c: F.substring(c, 17, 1 << 30).cast(kind))


def connected_groups(edges: DataFrame, src: str = "src", dst: str = "dst", *, max_rounds: int = 64) -> DataFrame:
    """(``vertex``, ``group``) for every vertex in a row with both ends; group is the least vertex.

    Rows with a NULL end tie nothing and name no vertex. Rows ``x, x`` make x a
    vertex of its own. Repeated rows and both directions of a pair count once. An
    empty table gives an empty result; other columns are not read. Vertices may
    be of any ordered type that casts to a string and back.

    Every step is a map-side combined aggregate or a join with a one-row-a-vertex
    table in which hot vertices are broadcast (at most 1 / HOT_SHARE of them), so
    neither a hub nor a giant component is ever gathered in one task. Each round
    is written to the shared folder, where the tables of the round before are
    deleted; the driver sees row counts and the bounded list of hot vertices only.
    """
    ws = Workspace(edges.sparkSession, "groups")
    name, back = _labels(edges.schema[src].dataType)
    other = F.col(dst).cast(edges.schema[src].dataType)
    graph = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(name(F.col(src)).alias("a"), name(other).alias("b"))
    size = graph.count()
    layers: list[DataFrame] = []
    rounds = 0
    while size:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        r = f"{rounds:02d}"
        links = _both_ways(graph)
        least = ws.save(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), f"least{r}")
        hot = hot_keys(least, "u", "n", 2 * size)
        told = lookup_join(links, least.select("u", "m"), "u", hot).select(F.col("v").alias("x"), "m")
        told = ws.save(told.unionAll(least.select("u", "m")).distinct(), f"told{r}")
        node = ws.save(told.groupBy("x").agg(F.min("m").alias("to"), F.max(F.col("x") == F.col("m")).alias("chosen"), F.count(F.lit(1)).alias("n")), f"node{r}")
        ws.drop(f"least{r}", *([f"graph{rounds - 1:02d}"] if rounds > 1 else []))
        layers.append(node)
        hot = hot_keys(node, "x", "n", told.count())
        more = lookup_join(told, node.where("n > 1").select("x", "to"), "x", hot).where("m <> to").select(F.col("to").alias("a"), F.col("m").alias("b"))
        graph = ws.save(more.distinct(), f"graph{r}")
        size = graph.count()
        ws.drop(f"told{r}")
    if not layers:
        return edges.select(F.col(src).alias("vertex"), F.col(src).alias("group")).where("false")
    done = layers[-1].where("false").select(F.col("x").alias("vertex"), F.col("x").alias("group"))
    for i, node in enumerate(layers):
        seed = node.where("chosen and n = 1").select("x")
        if i + 1 < len(layers):  # told of nothing but itself, but others were told of it too
            seed = seed.join(layers[i + 1].select("x"), "x", "left_anti")
        done = done.unionAll(seed.select("x", F.col("x").alias("group")))
    done = ws.save(done, "seeds")
    vertices = layers[0].count()
    for i in range(len(layers) - 1, -1, -1):
        child = layers[i].where("not chosen").select(F.col("x").alias("vertex"), F.col("to").alias("parent"))
        hot = hot_keys(child.groupBy("parent").count(), "parent", "count", layers[i].count())
        named = lookup_join(child, done.select(F.col("vertex").alias("parent"), "group"), "parent", hot)
        done = done.unionAll(ws.save(named.select("vertex", "group"), f"named{i:02d}"))
        ws.drop(f"node{i + 1:02d}")
    first = ws.save(done.groupBy("group").agg(F.min(back(F.col("vertex"))).alias("least"), F.count(F.lit(1)).alias("n")), "first")
    hot = hot_keys(first, "group", "n", vertices)
    return lookup_join(done, first.select("group", "least"), "group", hot).select(back(F.col("vertex")).alias("vertex"), F.col("least").alias("group"))
