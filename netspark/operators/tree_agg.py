"""Per-key figures where a few keys hold most of the rows.

Multi-level tree aggregation: rows are combined first within chunks of bounded
size, then the states of ``fan_in`` chunks at a time are merged, round after
round, until one state a key is left. A reducer never gets more than ``fan_in``
states of one key from one round, however hot the key is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions.clean import usable
from netspark.operators.lookup import MAX_HOT


def tree_rounds(n_rows: int, chunk_rows: int, fan_in: int) -> int:
    """Rounds after which ``fan_in ** rounds`` chunks of ``chunk_rows`` hold ``n_rows``."""
    chunks = max(1, math.ceil(n_rows / max(1, chunk_rows)))
    rounds = 0
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def partner_stats(edges: DataFrame, key: str = "src", partner: str = "dst", weight: str = "weight", *, chunk_rows: int = 65_536, fan_in: int = 8, n_rows: int | None = None) -> DataFrame:
    """Distinct partners and sum, least and greatest usable weight of every key.

    Result: ``key``, ``n_partners`` long, ``sum_weight``, ``min_weight``,
    ``max_weight`` double; one row per non-NULL key that has at least one
    partner, in which partners count if they have a usable weight (not NULL, not
    NaN). Keys without any usable weight have 0 partners and NULL figures. Rows
    alike in every column of ``edges`` count once. A NULL partner is no partner,
    and its weight does not count. An empty table gives an empty table.

    Only keys of more than ``chunk_rows`` rows, of which there are at most
    ``MAX_HOT``, go through the tree: the chunk of a row is taken from the hash of its
    partner, so a (key, partner) pair is never in two chunks and counts of distinct
    pairs simply add up. The whole-row ``distinct`` and the pair aggregate spread a
    hot key over all tasks; each further round shuffles at most one state per hot
    key and chunk. All other keys need one aggregate, in which a reducer gets one
    combined state a key and task. ``edges`` is read three times.
    """
    if n_rows is None:
        n_rows = edges.count()  # from the Parquet footers
    rounds = tree_rounds(n_rows, chunk_rows, fan_in)
    rows = edges.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[0] for r in rows.where(F.col("n") > max(chunk_rows, n_rows / MAX_HOT)).select(key).collect()] if rounds else []
    w = F.when(usable(weight), F.col(weight).cast("double"))

    def pairs(some: DataFrame) -> DataFrame:
        p = some.distinct().where(F.col(key).isNotNull() & F.col(partner).isNotNull()).select(F.col(key).alias("k"), F.col(partner).alias("p"), w.alias("w"))
        p = p.groupBy("k", "p").agg(F.sum("w").alias("s"), F.min("w").alias("lo"), F.max("w").alias("hi"))
        return p.select("k", "p", F.when(F.col("lo").isNotNull(), 1).otherwise(0).cast("long").alias("n"), "s", "lo", "hi")

    merge = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    if hot:
        tree = pairs(edges.where(F.col(key).isin(hot))).withColumn("chunk", F.pmod(F.xxhash64("p"), F.lit(fan_in**rounds)))
        for _ in range(rounds):
            tree = tree.groupBy("k", "chunk").agg(*merge).withColumn("chunk", F.expr(f"chunk div {fan_in}"))
        state = pairs(edges.where(~F.col(key).isin(hot))).drop("p").unionAll(tree.drop("chunk"))
    else:
        state = pairs(edges)
    return state.groupBy("k").agg(*merge).select(F.col("k").alias(key), F.col("n").alias("n_partners"), F.col("s").alias("sum_weight"), F.col("lo").alias("min_weight"), F.col("hi").alias("max_weight"))


def heavy_keys(stats: DataFrame, key: str = "src", count: str = "n_partners", share: float = 0.005) -> DataFrame:
    """The keys that hold at least ``share`` of the whole count: at most 1 / share of them.

    ``stats`` is read twice (total, filter): pass a written table. No rows, or a
    total of 0, gives no keys.
    """
    total = stats.agg(F.sum(count).alias("n")).first().n or 0
    return stats.where((F.col(count) >= share * total) & (F.col(count) > 0)).select(key)
