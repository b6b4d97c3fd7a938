"""Sparse algebra on (row, col, val) and (idx, x) tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions.clean import guard0
from netspark.operators.lookup import MAX_HOT, SMALL_BYTES, hot_keys, lookup_join
from netspark.workspace import Workspace


PRODUCTS = 1 << 22  # products of one inner index that a task may form


def spmv(edges: DataFrame, vec: DataFrame, hot: list | None = (), value: str = "weight", x: str = "x") -> DataFrame:
    """(idx, y): y[dst] = sum over src of value * x[src], for the dst that have in-edges."""
    e = lookup_join(edges.select(F.col("src").alias("idx"), "dst", value), vec.select("idx", x), "idx", hot)
    return e.groupBy(F.col("dst").alias("idx")).agg(F.sum(F.col(value) * F.col(x)).alias("y"))


DENSE = 500  # cells that a block product may compute for each product it saves the join


def _by_blocks(l: DataFrame, r: DataFrame, rows: int, cols: int, block: int = 512) -> DataFrame:
    """(row, col, val) from one task for each pair of a block of rows and one of columns.

    A task multiplies dense pieces of at most ``block`` rows or columns by 4,096 inner indexes.
    """
    nr, nc = -(-rows // block), -(-cols // block)
    kind, other = l.schema["row"].dataType.simpleString(), r.schema["col"].dataType.simpleString()
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    left = l.select(part("row", nr).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("j"), "row", none(other).alias("col"), "k", F.col("va").alias("v"))
    right = r.select(F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("i"), part("col", nc).alias("j"), none(kind).alias("row"), "col", "k", F.col("vb").alias("v"))

    def multiply(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["row"].notna()], g[g["row"].isna()]
        ar, ai = np.unique(a["row"].to_numpy(), return_inverse=True)
        bc, bi = np.unique(b["col"].to_numpy(), return_inverse=True)
        k = np.intersect1d(a["k"].to_numpy(), b["k"].to_numpy())
        out, met = np.zeros((len(ar), len(bc))), np.zeros((len(ar), len(bc)), bool)
        for x in range(0, len(k), 4096):
            some = k[x : x + 4096]
            da, db = np.zeros((len(ar), len(some))), np.zeros((len(some), len(bc)))
            for d, t, at in ((da, a, ai), (db.T, b, bi)):
                p = np.minimum(np.searchsorted(some, t["k"].to_numpy()), len(some) - 1)
                hit = some[p] == t["k"].to_numpy()
                np.add.at(d, (at[hit], p[hit]), t["v"].to_numpy()[hit])
            out += da @ db
            met |= (da != 0).astype("f4") @ (db != 0).astype("f4") > 0  # products may cancel, and are entries all the same
        x, y = np.nonzero(met)
        return pd.DataFrame({"row": ar[x], "col": bc[y], "val": out[x, y]})

    return left.unionAll(right).groupBy("i", "j").applyInPandas(multiply, f"row {kind}, col {other}, val double")


def spgemm(a: DataFrame, b: DataFrame, products: int = PRODUCTS) -> DataFrame:
    """The product of two (row, col, val) matrices.

    Where the products are many against the cells of the result, dense blocks are
    multiplied (``_by_blocks``); else it is a join on the inner index. Entries whose
    products are all 0 may be missing or 0. Ends must not be NULL.

    An inner index k with many entries on both sides makes their product of rows.
    Where that exceeds ``products`` its left entries are split over several parts, each of
    which meets a copy of the right ones, so no task forms more. Pass written tables.
    """
    l, r = a.select("row", F.col("col").alias("k"), F.col("val").alias("va")), b.select(F.col("row").alias("k"), "col", F.col("val").alias("vb"))
    both = l.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("nl")).join(r.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("nr")), "k").withColumn("p", F.col("nl") * F.col("nr"))
    total, most = both.agg(F.sum("p"), F.max("p")).first()
    rows, cols = (x.select(c).distinct().count() for x, c in ((l, "row"), (r, "col")))
    if (total or 0) > products and float(rows) * cols * both.count() <= DENSE * total:
        return _by_blocks(l, r, rows, cols)
    least = max(products, (total or 0) / MAX_HOT)
    if (most or 0) <= least:
        pairs = l.join(r, "k")
    else:
        heavy = both.where(F.col("p") > least).select("k", F.least("nl", F.ceil(F.col("p") / products)).cast("int").alias("parts"))  # at most MAX_HOT rows
        ls = l.join(F.broadcast(heavy), "k", "left").select("row", "k", "va", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
        rs = r.join(F.broadcast(heavy), "k", "left").select("k", "col", "vb", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        pairs = ls.join(rs, ["k", "part"])
    return pairs.groupBy("row", "col").agg(F.sum(F.col("va") * F.col("vb")).alias("val"))


def sums_by(m: DataFrame, by: str) -> tuple[DataFrame, list | None]:
    """(``by``, s) of a (row, col, val) matrix as a written table, and its hot keys for ``lookup_join``."""
    s = Workspace(m.sparkSession, "sums").save(m.groupBy(by).agg(F.sum("val").alias("s"), F.count(F.lit(1)).alias("n")), "s")
    keys, entries = s.agg(F.count(F.lit(1)), F.sum("n")).first()
    return s.select(by, "s"), None if keys * 64 <= SMALL_BYTES else hot_keys(s, by, "n", entries or 0)


def normalise(m: DataFrame, by: str) -> DataFrame:
    """Rows (``by`` = 'row') or columns ('col') scaled to sum 1; a sum of 0 leaves zeros. Reads ``m`` twice."""
    s, hot = sums_by(m, by)
    return lookup_join(m, s, by, hot).select("row", "col", (F.col("val") / guard0(F.col("s"))).alias("val"))


def norms(vec: DataFrame, x: str = "x") -> DataFrame:
    """One row with the L1, L2 and max norm of a vector."""
    a = F.abs(F.col(x))
    return vec.agg(F.sum(a).alias("l1"), F.sqrt(F.sum(F.col(x) * F.col(x))).alias("l2"), F.max(a).alias("max"))
