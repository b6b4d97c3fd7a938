"""Joining rows with one-row-a-key tables when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.002  # a key with this share of the rows is hot,
HOT_ROWS = 5_000_000  # and so is one with so many rows,
MAX_HOT = 10_000  # while there are at most so many of them
SMALL_BYTES = 16 << 20  # a lookup table that takes no more, by its counted rows, is broadcast whole


def hot_keys(counts: DataFrame, key: str, count: str, total: int, share: float = HOT_SHARE) -> list:
    """Keys with ``share`` of ``total`` rows or ``HOT_ROWS`` rows: never more than ``MAX_HOT`` or 1 / share."""
    return [r[0] for r in counts.where(F.col(count) >= max(2, total / MAX_HOT, min(share * total, HOT_ROWS))).select(key).collect()]


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, hot: list | None, how: str = "inner") -> DataFrame:
    """Join (``how``: inner or left) with a table that has one row a key, hot keys apart from the rest.

    The rows of hot keys stay where they are and meet a broadcast of the lookup's
    rows for those keys, of which there are at most ``len(hot)``; all other keys
    are shuffled, and none of them holds more than the hot share of the rows.
    ``hot`` is None where the caller counted that the whole lookup is small
    (``SMALL_BYTES``): then it is broadcast. NULL keys match nothing; a left join keeps their rows.
    """
    if hot is None:
        return rows.join(F.broadcast(lookup), key, how)
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = rows.where(~is_hot).join(lookup.where(~is_hot), key, how)
    return cold.unionByName(rows.where(is_hot).join(F.broadcast(lookup.where(is_hot)), key, how))
