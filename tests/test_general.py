"""Hot keys, lookups, table differences and standing rows on small hand-made tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from netspark.functions.clean import tidy_key, usable
from netspark.operators.diff import diff_tables
from netspark.operators.lookup import hot_keys, lookup_join
from netspark.operators.standing import standing_rows
from netspark.operators.tree_agg import heavy_keys, partner_stats, tree_rounds

EDGE = "src int, dst int, weight float, n_partners string"
NAN = float("nan")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tidy_key_and_usable(spark):
    df = spark.createDataFrame([(" ab\t", 1.0), (None, None), ("", NAN)], "k string, x double")
    assert [r[0] for r in df.select(tidy_key("k")).collect()] == ["AB", None, ""]
    assert [r[0] for r in df.select(usable("x")).collect()] == [True, False, False]


def test_standing_rows_takes_the_last(spark):
    t = lambda h: dt.datetime(2031, 1, 1, h)
    df = spark.createDataFrame([(" a", t(1), t(9), 1.0), ("A ", t(2), t(3), None), ("b", None, None, 5.0), (None, t(1), t(1), 7.0), ("A", t(1), t(9), 1.0)], "g string, computed_at timestamp, loaded_at timestamp, x double")
    got = standing_rows(df, tidy_key("g"), ["x"], name="g").collect()
    assert {r.g: r.x for r in got} == {"A": None, "B": 5.0}
    assert standing_rows(df.limit(0), tidy_key("g"), ["x"]).count() == 0


def test_partner_stats_nulls_ties_repeats_and_clashing_names(spark):
    data = [(1, 2, 0.5, "x"), (1, 2, 0.5, "x"), (1, 2, 0.25, "x"), (1, 3, NAN, "x"), (1, None, 9.0, "x"), (None, 1, 1.0, "x"), (2, 3, None, None), (3, 3, 1.0, None)]
    got = partner_stats(spark.createDataFrame(data, EDGE))
    assert rows(got, "src", "n_partners", "sum_weight", "min_weight", "max_weight") == [(1, 1, 0.75, 0.25, 0.5), (2, 0, None, None, None), (3, 1, 1.0, 1.0, 1.0)]
    assert partner_stats(spark.createDataFrame([], EDGE)).count() == 0


def test_partner_stats_does_not_depend_on_the_rounds(spark):
    rng = random.Random(5)
    data = [(0 if rng.random() < 0.4 else rng.randrange(50), rng.randrange(300), rng.random(), None) for _ in range(3000)]
    df = spark.createDataFrame(data, EDGE)
    flat = rows(partner_stats(df).select("src", "n_partners", F.round("sum_weight", 4), "min_weight", "max_weight"), "*")
    tree = partner_stats(df, chunk_rows=40, fan_in=3)
    assert rows(tree.select("src", "n_partners", F.round("sum_weight", 4), "min_weight", "max_weight"), "*") == flat
    brute = {}
    for s, d, _, _ in data:
        brute.setdefault(s, set()).add(d)
    assert {r[0]: r[1] for r in flat} == {s: len(d) for s, d in brute.items()}


def test_tree_rounds():
    assert tree_rounds(0, 10, 8) == 0
    assert tree_rounds(11, 10, 8) == 1
    assert 8 ** tree_rounds(10**10, 65536, 8) * 65536 >= 10**10


def test_heavy_keys(spark):
    df = spark.createDataFrame([(1, 50), (2, 49), (3, 1), (4, 0)], "src int, n_partners long")
    assert rows(heavy_keys(df, share=0.1), "src") == [(1,), (2,)]
    assert heavy_keys(df.limit(0)).count() == 0


def test_lookup_join_sets_hot_keys_apart(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 20)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 15)], "k int, name string")
    hot = hot_keys(left.groupBy("k").count(), "k", "count", 69, 0.2)
    assert hot == [1]
    assert rows(lookup_join(left, right, "k", hot), "k", "v", "name") == rows(left.join(right, "k"), "k", "v", "name")


def test_diff_reports_sides_and_fields(spark):
    s = "k string, a double, b int, field string"
    left = spark.createDataFrame([("x", 1.0, 1, "q"), ("y", NAN, None, "q"), ("z", 1.0, 2, "q"), ("only", 1.0, 1, None), (None, 1.0, 1, None), ("x", 1.0, 1, "q")], s)
    right = spark.createDataFrame([("x", 1.0 + 1e-9, 1, "w"), ("y", None, None, "w"), ("z", 2.0, None, "w"), ("new", None, 1, None), (None, 1.0, 1, None)], s)
    got = diff_tables(left, right, "k", {"a": 1e-6, "b": None}, partitions=3)
    assert rows(got, "k", "field", "issue") == [("new", "*", "only_right"), ("only", "*", "only_left"), ("z", "a", "differs"), ("z", "b", "differs")]
    assert {tuple(r) for r in got.where("k = 'z' and field = 'b'").select("left_value", "right_value").collect()} == {("2", None)}


def test_diff_empty_and_one_sided(spark):
    s = "k string, a double"
    some, none = spark.createDataFrame([("x", 1.0), ("", 2.0)], s), spark.createDataFrame([], s)
    assert diff_tables(none, none, "k", {"a": None}).count() == 0
    assert rows(diff_tables(some, none, "k", {"a": None}), "k", "issue") == [("", "only_left"), ("x", "only_left")]
    assert rows(diff_tables(none, some, "k", {"a": None}), "k", "issue") == [("", "only_right"), ("x", "only_right")]
    assert diff_tables(some, some, "k", {"a": 1e-6}).count() == 0


def test_diff_across_batches_and_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        n = 500
        left = spark.range(n).where("id % 11 <> 0").selectExpr("cast(id as string) k", "cast(id as double) a")
        right = spark.range(n).where("id % 13 <> 0").selectExpr("cast(id as string) k", "cast(id + if(id % 17 = 0, 1, 0) as double) a")
        got = {(r.k, r.issue) for r in diff_tables(left, right, "k", {"a": 1e-9}, partitions=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for i in range(n):
        le, ri = i % 11 != 0, i % 13 != 0
        if le != ri:
            want.add((str(i), "only_left" if le else "only_right"))
        elif le and i % 17 == 0:
            want.add((str(i), "differs"))
    assert got == want


def test_workspace_cleans_up(spark):
    import os

    from netspark.workspace import Workspace, clean

    ws = Workspace(spark, "gone")
    ws.save(spark.range(3), "a")
    assert os.path.isdir(ws.path)
    clean(spark)
    assert not os.path.exists(ws.path)
