"""Filling containers of fixed capacity: sum-of-squares online packing.

A shard of the items is packed by one task. The level array counts the partly
filled containers (windows) at every fill level; each item goes where the sum of
the squared counts afterwards is least. A shard takes its items by falling size,
which fills small containers better than the order of arrival. What is still open at the end of a shard
is closed by merging windows that fit into one another, again by fill level.
Shards hold enough containers that the open rest of one is small against them,
and their number grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, all with 1 <= size <= capacity, taken in the given order."""
    # gain[h]: 2 N(h) - 1, what leaving level h takes off the sum; loss[h]: 2 N(h) + 1, what reaching it adds
    never = -(1 << 60)
    gain = np.full(capacity + 1, never, np.int64)
    gain[0] = 0
    loss = np.ones(capacity + 1, np.int64)
    loss[capacity] = 0
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), np.int64)
    windows = 0
    for i, s in enumerate(sizes.tolist()):
        cost = loss[s:] - gain[: capacity + 1 - s]
        h = capacity - s - int(cost[::-1].argmin())  # of equal costs the fullest window
        if h:
            w = at[h].pop()
            gain[h] = gain[h] - 2 if at[h] else never
            loss[h] -= 2
        else:
            w, windows = windows, windows + 1
        where[i] = w
        h += s
        if h < capacity:
            gain[h] = 2 * len(at[h]) + 1
            loss[h] += 2
            at[h].append(w)
    return where


def close_windows(where: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Merge windows left open: the fullest takes the largest others that still fit, and so on."""
    if not len(where):
        return where
    level = np.bincount(where, sizes).astype(np.int64)
    into = np.arange(len(level))
    open_ = np.flatnonzero(level < capacity)
    order = open_[np.argsort(-level[open_], kind="stable")]
    lv = level[order]
    alive = np.ones(len(order), bool)
    by: list[list[int]] = [[] for _ in range(capacity + 1)]
    for p in range(len(order) - 1, -1, -1):
        by[lv[p]].append(p)
    have = np.array([bool(x) for x in by])
    for p in range(len(order)):
        if not alive[p]:
            continue
        alive[p] = False
        room = capacity - lv[p]
        while room > 0:
            fit = np.flatnonzero(have[1 : room + 1])
            if not len(fit):
                break
            h = int(fit[-1]) + 1
            while by[h] and not alive[by[h][-1]]:
                by[h].pop()
            if not by[h]:
                have[h] = False
                continue
            q = by[h].pop()
            alive[q] = False
            into[order[q]] = order[p]
            room -= h
    _, dense = np.unique(into[where], return_inverse=True)
    return dense


def pack(sizes: DataFrame, profiles: DataFrame, ident: str = "doc_id", size: str = "n_tokens", profile: str = "profile", capacity: str = "capacity_tokens", *, shard_windows: int = 2048, max_profiles: int = 1000) -> DataFrame:
    """Container, position and token range of every item or piece, for every profile.

    Result: ``profile``, ``capacity``, ``container`` string, ``position`` int
    (0-based within the container), ``ident``, ``piece`` int, ``token_start``
    and ``token_end`` long (end excluded); the pieces of an item cover it once.
    An item is cut only if it alone exceeds the capacity: into pieces of the
    whole capacity and one rest, which is packed like any other item.

    Items of NULL or non-positive size have nothing to place. A NULL ident is an
    item like any other, repeated rows are repeated items; ties in size go by
    ident. Profiles with a NULL or non-positive capacity hold nothing; equal
    profiles count once. Empty tables give an empty result. Other columns are
    not read. ``profiles`` is a control table of at most ``max_profiles`` rows.

    ``sizes`` is read twice, once for its total: pass a written table. A shard
    gets the items of one profile worth ``shard_windows`` full containers, so the
    work of a task is bounded and the number of tasks follows the data.
    """
    plan = profiles.select(F.col(profile).alias("profile"), F.col(capacity).cast("long").alias("capacity")).where("capacity > 0").distinct().limit(max_profiles + 1).collect()
    if len(plan) > max_profiles:
        raise ValueError(f"more than {max_profiles} profiles")
    kind = sizes.schema[ident].dataType.simpleString()
    items = sizes.select(F.col(ident).alias("ident"), F.col(size).cast("long").alias("n")).where("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    shards = {p.capacity: max(1, round(total / (shard_windows * p.capacity))) for p in plan}
    schema = f"profile string, capacity long, container string, position int, `{ident}` {kind}, piece int, token_start long, token_end long"
    if not plan:
        return items.selectExpr("cast(null as string) profile", "0L capacity", "'' container", "0 position", f"ident as `{ident}`", "0 piece", "0L token_start", "n as token_end").where("false")
    into = F.array(*[F.struct(F.lit(p.profile).alias("profile"), F.lit(p.capacity).cast("long").alias("capacity"), F.lit(shards[p.capacity]).alias("of")) for p in plan])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        cap = int(g["capacity"].iat[0])
        g = g.sort_values(["n", "ident"], ascending=[False, True], kind="stable")
        n = g["n"].to_numpy(np.int64)
        whole, rest = np.divmod(n, cap)
        short = n <= cap
        whole[short], rest[short] = 0, n[short]
        i = np.flatnonzero(rest)
        i = i[np.argsort(-rest[i], kind="stable")]
        w = close_windows(sum_of_squares(rest[i], cap), rest[i], cap)
        head = np.repeat(np.arange(len(n)), whole)  # the pieces that fill a container each
        nth = np.arange(len(head)) - np.repeat(np.cumsum(whole) - whole, whole)
        first = (int(w.max()) + 1) if len(w) else 0
        row = np.concatenate([i, head])
        window = np.concatenate([w, first + np.arange(len(head))])
        piece = np.concatenate([whole[i], nth])
        order = np.argsort(window, kind="stable")
        row, window, piece = row[order], window[order], piece[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        start = piece * cap
        mark = f"{g['profile'].iat[0]}-{int(g['shard'].iat[0])}-"
        out = pd.DataFrame({"profile": g["profile"].iat[0], "capacity": cap, "container": [mark + str(x) for x in window], "position": place.astype("i4")})
        out[ident] = g["ident"].to_numpy()[row] if not g["ident"].isna().any() else g["ident"].iloc[row].reset_index(drop=True)
        return out.assign(piece=piece.astype("i4"), token_start=start, token_end=np.minimum(start + cap, n[row]))

    spread = items.select("ident", "n", F.explode(into).alias("p")).select("ident", "n", "p.profile", "p.capacity", F.pmod(F.xxhash64("ident", "n"), F.col("p.of")).cast("int").alias("shard"))
    return spread.groupBy("profile", "capacity", "shard").applyInPandas(one, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and fill of every profile."""
    per = packed.groupBy("profile", "capacity", "container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count(F.lit(1)).alias("k"))
    agg = per.groupBy("profile", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return agg.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
