"""The standing row of each key: the one computed last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standing_rows(df: DataFrame, key: Column, values: Sequence[str], version: Sequence[str] = ("computed_at", "loaded_at"), name: str = "key") -> DataFrame:
    """One row per key with the ``values`` of the row whose ``version`` is greatest.

    One aggregate with map-side combine, so a key with many re-runs is reduced
    before the shuffle. NULL keys belong to nothing and are left out; a NULL
    version is the least; of rows alike in every version column the one with the
    greater values (NULL least, NaN greatest) stands, so the result does not
    depend on row order. Repeated rows count once. An empty table gives an empty
    table. Other columns of ``df`` are not read.
    """
    row = F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(version)], *[F.col(v).alias(f"x{i}") for i, v in enumerate(values)])
    best = df.select(key.alias(name), row.alias("row")).where(F.col(name).isNotNull()).groupBy(name).agg(F.max("row").alias("row"))
    return best.select(name, *[F.col(f"row.x{i}").alias(v) for i, v in enumerate(values)])
