"""Differences between two copies of a table, key by key and field by field.

Both copies are range-partitioned with the same split points, each partition is
sorted by key, and a two-pointer merge runs over the sorted stream. The merge
keeps one Arrow batch at a time, so its memory does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions.clean import is_float, nan_to_null


PARTITION_ROWS = 1 << 20


def _merge(fields: list[tuple[str, float | None]]):
    """The merge over one sorted stream of (k, side, f0...); left rows are side 0."""
    names = [n for n, _ in fields]
    out = pa.schema([("k", pa.string()), ("field", pa.string()), ("issue", pa.string()), ("left_value", pa.string()), ("right_value", pa.string())])

    def emit(k, field: str, issue: str, left=None, right=None) -> pa.RecordBatch:
        n = len(k)
        none = pa.nulls(n, pa.string())
        text = lambda a: none if a is None else a.cast(pa.string())
        return pa.RecordBatch.from_arrays([k, pa.array([field] * n, pa.string()), pa.array([issue] * n, pa.string()), text(left), text(right)], schema=out)

    def differ(a: pa.Array, b: pa.Array, tol: float | None) -> pa.Array:
        one_null = pc.xor(pc.is_null(a), pc.is_null(b))
        if tol is None:
            unequal = pc.not_equal(a, b)
        else:
            gap = pc.abs(pc.subtract(a, b))
            unequal = pc.and_(pc.not_equal(a, b), pc.invert(pc.less_equal(gap, pc.multiply(pc.max_element_wise(pc.abs(a), pc.abs(b)), tol))))
        return pc.or_(one_null, pc.fill_null(unequal, False))

    def step(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        n = t.num_rows
        if n == 0:
            return [], None
        k, side = t["k"].combine_chunks(), t["side"].combine_chunks()
        head = pc.equal(k.slice(0, n - 1), k.slice(1))
        pair = pc.fill_null(head, False)  # row i and row i + 1 have one key
        first = pa.concat_arrays([pair, pa.array([False])])
        second = pa.concat_arrays([pa.array([False]), pair])
        lone = pc.invert(pc.or_(first, second))
        keep = None
        if not last:  # the other side of the last row may be in the next batch
            if lone[n - 1].as_py():
                keep = t.slice(n - 1)
                lone = pa.concat_arrays([lone.slice(0, n - 1), pa.array([False])])
        res = []
        for s, issue in ((0, "only_left"), (1, "only_right")):
            ks = k.filter(pc.and_(lone, pc.equal(side, s)))
            if len(ks):
                res.append(emit(ks, "*", issue))
        left, right = t.filter(first), t.filter(second)
        if left.num_rows:
            lk = left["k"].combine_chunks()
            for i, (name, tol) in enumerate(fields):
                a, b = left[f"f{i}"].combine_chunks(), right[f"f{i}"].combine_chunks()
                m = differ(a, b, tol)
                if pc.any(m).as_py():
                    res.append(emit(lk.filter(m), name, "differs", a.filter(m), b.filter(m)))
        return res, keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if keep is not None:
                t = pa.concat_tables([keep.cast(t.schema), t])
            res, keep = step(t, last=False)
            yield from res
        if keep is not None:
            yield from step(keep, last=True)[0]

    assert names
    return run


def diff_tables(left: DataFrame, right: DataFrame, key: str, fields: Mapping[str, float | None], *, partitions: int | None = None, rows: int = 0) -> DataFrame:
    """Keys on one side only, and fields that differ, of two tables with one row a key.

    ``fields`` maps each compared column (in both tables, of types that cast to
    one another) to a relative tolerance, or to None for exact equality. Result:
    ``key`` string, ``field``, ``issue`` (``only_left``, ``only_right`` with
    field ``*``, or ``differs``), ``left_value``, ``right_value`` strings.

    NULL and NaN are one missing value: two agree, one alone differs. Keys are
    compared as strings; rows with a NULL key are left out, as they name nothing.
    Should a key be repeated on a side, its greatest row of field values is taken
    (combined before the shuffle, so a hot key costs nothing). Two empty tables
    give an empty result; columns that are not compared are not read. ``rows`` is an
    upper bound of the rows of both, from which the number of partitions grows.
    """
    spec: list[tuple[str, float | None]] = list(fields.items())
    types = {n: (left.schema[n].dataType, right.schema[n].dataType) for n, _ in spec}

    def side(df: DataFrame, mark: int) -> DataFrame:
        cols = []
        for i, (n, tol) in enumerate(spec):
            c = F.col(n)
            if is_float(df.schema[n].dataType):
                c = nan_to_null(c)
            if tol is not None or any(is_float(t) for t in types[n]):
                c = c.cast("double")
            else:
                c = c.cast("string")
            cols.append(c.alias(f"f{i}"))
        one = df.select(F.col(key).cast("string").alias("k"), F.struct(*cols).alias("r")).where("k is not null").groupBy("k").agg(F.max("r").alias("r"))
        return one.select("k", F.lit(mark).alias("side"), "r.*")

    both = side(left, 0).unionAll(side(right, 1))
    n = partitions or max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    merged = (
        both.repartitionByRange(n, "k")
        .sortWithinPartitions("k", "side")
        .mapInArrow(_merge(spec), "k string, field string, issue string, left_value string, right_value string")
    )
    return merged.withColumnRenamed("k", key)
