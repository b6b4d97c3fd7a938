"""Top N items within every group by simultaneous bisection of the groups' cutoffs.

An item's place in its group is an order-preserving code: words of at most 51
bits, first two from the bits of the score, then the identifier, six bytes a
word. All groups are refined at once. A pass counts the rows above 255 evenly
spaced midpoints of each group's open interval, which is eight bisection steps;
rows above the new interval are in, rows below are out, and only the rows inside
go on, until every group holds exactly N.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.functions.clean import usable
from netspark.operators.lookup import hot_keys, lookup_join
from netspark.workspace import Workspace

BYTES = 6


def sortable_bits(score: Column) -> Column:
    """A long that is ordered as the double it is made from; -0.0 is 0.0."""

    @F.pandas_udf("long")
    def bits(s: pd.Series) -> pd.Series:
        b = (s.to_numpy("f8") + 0.0).view("i8")
        return pd.Series(b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF))

    return bits(score.cast("double"))


def _word(j: Column, numeric: bool) -> Column:
    """Word number ``j`` of the code; a greater word is a better item."""
    if numeric:
        ident = [-F.shiftright(F.col("id"), 16), -F.col("id").bitwiseAND(0xFFFF)]
        tail = F.when(j == 2, ident[0]).otherwise(ident[1])
    else:
        raw = F.col("id").cast("binary")
        part = F.substring(raw, (j - 2) * BYTES + 1, F.lit(BYTES))
        value = F.conv(F.rpad(F.hex(part), 2 * BYTES, "0"), 16, 10).cast("long")
        tail = -(value * 8 + F.octet_length(part))  # the length tells the end from a NUL
    return F.when(j == 0, F.shiftright(F.col("bits"), 16)).when(j == 1, F.col("bits").bitwiseAND(0xFFFF)).otherwise(tail)


def top_n_per_group(items: DataFrame, group: str, ident: str, score: str, n: int, *, fan: int = 256) -> DataFrame:
    """(``group``, ``ident``, ``score``, ``rank``): the N greatest scores of every group.

    Equal scores go to the smaller ``ident`` (strings by their UTF-8 bytes, whole
    numbers by value). Groups with fewer items give all they have. Rows with a
    NULL group or ident, or a NULL or NaN score, do not count; rows alike in
    group, ident and score count once. An empty table gives an empty one, n < 1
    gives none. Columns besides the three are not read, so their names cannot
    clash; the result has the three names given here and ``rank`` from 1.

    A pass is one aggregate with at most ``fan`` counts a group and one join with
    the group's new interval, in which hot groups are broadcast; after the first
    pass only the rows inside the open intervals are read.
    """
    kind = items.schema[ident].dataType
    numeric = isinstance(kind, T.IntegralType)
    ws = Workspace(items.sparkSession, "topn")
    base = items.select(F.col(group).alias("g"), F.col(ident).cast("long" if numeric else "string").alias("id"), F.col(score).cast("double").alias("s"))
    base = base.where(F.col("g").isNotNull() & F.col("id").isNotNull() & usable("s")).distinct().withColumn("bits", sortable_bits(F.col("s")))
    base = ws.save(base, "items")
    size = base.count() if n > 0 else 0
    first = base.select(F.shiftright("bits", 16).alias("w")).agg(F.min("w"), F.max("w")).first()
    taken: list[DataFrame] = []
    lo, hi = (first[0] or 0), (first[1] or 0)
    rows = base.withColumns({"j": F.lit(0), "lo": F.lit(lo).cast("long"), "hi": F.lit(hi).cast("long"), "need": F.lit(n).cast("long")})
    step = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(float(fan))).cast("long"))
    p = 0
    while size:
        p += 1
        word, after = _word(F.col("j"), numeric), _word(F.col("j") + 1, numeric)
        coded = rows.withColumns({"w": word, "v": after}).withColumn("b", F.expr("(w - lo)") / step).withColumn("b", F.floor("b").cast("int"))
        counts = coded.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"), F.min("w").alias("w0"), F.max("w").alias("w1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
        best = Window.partitionBy("g").orderBy(F.desc("b"))
        counts = counts.withColumns({"upto": F.sum("c").over(best), "all": F.sum("c").over(Window.partitionBy("g"))})
        # the bucket in which the N-th item lies; a group with no more rows than it needs has its lowest one
        cut = counts.where((F.col("upto") - F.col("c") < F.col("need")) & ((F.col("upto") >= F.col("need")) | (F.col("upto") == F.col("all"))))
        cut = ws.save(cut.select("g", F.col("b").alias("cut"), (F.col("upto") <= F.col("need")).alias("whole"), (F.col("need") - F.col("upto") + F.col("c")).alias("left"), "w0", "w1", "v0", "v1", "all"), f"cut{p:02d}")
        hot = hot_keys(cut, "g", "all", size)
        part = lookup_join(coded.select("g", "id", "s", "bits", "j", "b"), cut, "g", hot).where("b >= cut")
        part = part.select("g", "id", "s", "bits", ((F.col("b") > F.col("cut")) | F.col("whole")).alias("in"), F.when(F.col("w0") == F.col("w1"), F.col("j") + 1).otherwise(F.col("j")).alias("j"), F.when(F.col("w0") == F.col("w1"), F.col("v0")).otherwise(F.col("w0")).alias("lo"), F.when(F.col("w0") == F.col("w1"), F.col("v1")).otherwise(F.col("w1")).alias("hi"), F.col("left").alias("need"))
        part = ws.save(part, f"pass{p:02d}")
        ws.drop(f"cut{p:02d}")
        taken.append(part.where(F.col("in")).select("g", "id", "s"))
        rows = part.where(~F.col("in")).drop("in")
        size = rows.count()
    out = taken[0] if taken else base.select("g", "id", "s").where("false")
    for t in taken[1:]:
        out = out.unionAll(t)
    place = Window.partitionBy("g").orderBy(F.desc("s"), F.col("id") if numeric else F.hex(F.col("id").cast("binary")))
    return out.withColumn("rank", F.row_number().over(place)).select(F.col("g").alias(group), F.col("id").cast(kind).alias(ident), F.col("s").alias(score), "rank")
