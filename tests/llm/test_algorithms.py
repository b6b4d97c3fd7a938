"""Groups of matches, top N and similar vectors against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netspark.llm import cells, graph_plans, knn
from netspark.llm.components import connected_groups
from netspark.llm.hnsw import Graph
from netspark.llm.topn import sortable_bits, top_n_per_group

NAN = float("nan")


def brute_groups(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def groups(spark, pairs, kind="int"):
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], f"src {kind}, dst {kind}, vertex string")
    got = connected_groups(df).collect()
    assert len({r.vertex for r in got}) == len(got)
    return {r.vertex: r.group for r in got}


def test_groups_chain_star_loops_nulls_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (300, None), (None, 301), (None, None), (1, 0), (0, 1), (-5, -3)]
    assert groups(spark, pairs) == brute_groups(pairs)


def test_groups_random_graphs(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-50, 250), rng.randrange(300)) for _ in range(220)]
    assert groups(spark, pairs) == brute_groups(pairs)


def test_groups_of_strings_and_longs(spark):
    pairs = [("b", "a"), ("c", "b"), ("", "z"), ("q", "q")]
    assert groups(spark, pairs, "string") == brute_groups(pairs)
    big = [(1 << 40, 3), (3, 1 << 50), (-9, -9)]
    assert groups(spark, big, "long") == brute_groups(big)


def test_labels_of_longs_are_a_permutation(spark):
    from netspark.llm.components import _labels

    v = [0, 1, -1, 5, 1 << 32, -(1 << 32), 2**63 - 1, -(2**63)] + list(range(1000, 1100))
    name, back = _labels(spark.createDataFrame([(1,)], "v long").schema["v"].dataType)
    got = spark.createDataFrame([(x,) for x in v], "v long").select("v", name(F.col("v")).alias("n")).select("v", "n", back(F.col("n")).alias("b")).collect()
    assert all(r.v == r.b for r in got) and len({r.n for r in got}) == len(v)
    inner = [r.n for r in got[8:]]
    assert 30 < sum(a < b for a, b in zip(inner, inner[1:])) < 70  # no trace of the order


def test_groups_empty(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(None, 1)]) == {}


def brute_top(rows, n):
    out = {}
    for g, i, s in {r[:3] for r in rows if None not in r[:3] and r[2] == r[2]}:
        out.setdefault(g, []).append((-s + 0.0, i))
    return {(g, i, k + 1) for g, v in out.items() for k, (_, i) in enumerate(sorted(v)[:n])}


def top(spark, rows, n, kind="string", **kw):
    df = spark.createDataFrame([(*r, 0) for r in rows], f"g string, i {kind}, s double, rank int")
    return {(r.g, r.i, r["rank"]) for r in top_n_per_group(df, "g", "i", "s", n, **kw).collect()}


def test_top_n_ties_nulls_repeats(spark):
    rows = [("a", "x1", 1.0), ("a", "x2", 1.0), ("a", "x3", 1.0), ("a", "x3", 1.0), ("a", "x0", 0.5), ("b", "y", -1.0), ("b", "z", NAN), (None, "q", 1.0), ("b", None, 1.0), ("c", "", 0.0), ("c", "w", None), ("c", "v", -0.0)]
    assert top(spark, rows, 2) == brute_top(rows, 2)


def test_top_n_long_common_prefixes_and_unicode(spark):
    rows = [("g", "p" * 200 + x, 2.0) for x in ("", "a", "ab", "b", "é", "\0", "a\0")]
    got = top(spark, rows, 3)
    want = sorted(("p" * 200 + x).encode() for x in ("", "a", "ab", "b", "é", "\0", "a\0"))[:3]
    assert {i.encode() for _, i, _ in got} == set(want)


def test_top_n_random_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", f"i{rng.randrange(10_000)}", rng.choice([rng.uniform(-1e9, 1e9), 0.25, 1e-310])) for _ in range(1500)]
    best = {}
    for g, i, s in rows:
        best.setdefault((g, i), s)
    rows = [(g, i, s) for (g, i), s in best.items()]
    assert top(spark, rows, 5, fan=8) == brute_top(rows, 5)


def test_top_n_numeric_ids_and_empty(spark):
    rows = [("a", 10, 1.0), ("a", 9, 1.0), ("a", -3, 1.0), ("a", 1 << 40, 1.0)]
    assert top(spark, rows, 3, "long") == {("a", -3, 1), ("a", 9, 2), ("a", 10, 3)}
    assert top(spark, [], 3) == set() and top(spark, rows, 0, "long") == set()


def test_sortable_bits_keep_the_order(spark):
    x = [-np.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "s double").coalesce(1).select(sortable_bits(F.col("s"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_graph_recall():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 24)).astype("f4")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, sims = Graph.build(v, 12, 40).search(v[:300], 6)
    want = np.argsort(-(v[:300] @ v.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids, want)]) > 0.95
    assert all(len(set(r)) == 6 for r in ids)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_graph_of_few(n):
    v = np.eye(8, dtype="f4")[:n]
    ids, _ = Graph.build(v).search(np.eye(8, dtype="f4")[:3], 4) if n else Graph(v, [np.empty((0, 32), "i4")], 16).search(np.eye(8, dtype="f4")[:3], 4)
    assert all(sorted(x for x in r if x >= 0) == list(range(min(n, 4))) or n > 4 for r in ids)


def near(spark, data, k=3, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "id string, v array<double>, rank int")
    return {(r.id, r["rank"]): (r.neighbour, r.cosine) for r in knn.nearest_vectors(df, "id", "v", k, **kw).collect()}


def brute_near(data, k):
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    out = {}
    for a, u in ok.items():
        best = sorted((-round(float(u @ w), 6), b) for b, w in ok.items() if b != a)[:k]
        out |= {(a, r + 1): (b, -c) for r, (c, b) in enumerate(best)}
    return out


def agree(got, want):
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)


def test_near_copies_ties_and_unusable(spark):
    data = [(f"c{i:02d}", [1.0, 0.0, 0.0]) for i in range(9)] + [("s", [2.0, 0.0, 0.0]), ("t", [0.0, 1.0, 0.0]), ("u", [0.0, -1.0, 1.0])]
    bad = [("n1", [1.0, None, 0.0]), ("n2", [NAN, 1.0, 0.0]), ("n3", [0.0, 0.0, 0.0]), ("n4", None), (None, [1.0, 1.0, 1.0]), ("n5", []), ("n6", [float("inf"), 0.0, 0.0])]
    agree(near(spark, data + bad), brute_near(data, 3))
    assert near(spark, []) == {} and near(spark, [("a", [1.0])]) == {}


def test_near_over_several_shards(spark):
    rng = np.random.default_rng(4)
    data = [(f"v{i:03d}", list(map(float, rng.standard_normal(8)))) for i in range(300)]
    agree(near(spark, data, shard_rows=60), brute_near(data, 3))


def test_near_recall_over_64_shards(spark):
    rng = np.random.default_rng(5)
    mid = rng.standard_normal((40, 32))
    data = [(f"v{i:04d}", list(map(float, mid[i % 40] + (0.1 if i % 2 else 3.0) * rng.standard_normal(32)))) for i in range(6400)]
    got = {}
    for (i, _), (c, _) in near(spark, data, 5, shard_rows=100).items():
        got.setdefault(i, set()).add(c)
    u = np.array([v for _, v in data])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[f"v{i:04d}"] & {f"v{j:04d}" for j in w}) / 5 for i, w in enumerate(want)]) > 0.98


def test_near_copies_with_noise_go_by_id(spark):
    """A third of the rows are near copies whose cosines all round to 1: the smallest ids win."""
    rng = np.random.default_rng(7)
    mid = rng.standard_normal(16)
    data = [(f"v{i:04d}", list(map(float, mid + 1e-5 * rng.standard_normal(16) if i % 3 == 0 else rng.standard_normal(16)))) for i in range(900)]
    want = brute_near(data, 5)
    for rows in (1000, 200):
        got = near(spark, data, 5, shard_rows=rows)
        assert got.keys() == want.keys()
        assert all(got[x] == want[x] for x in want if int(x[0][1:]) % 3 == 0)
        assert np.mean([got[x][0] == want[x][0] for x in want]) > 0.99


def test_near_of_float_elements(spark):
    rng = np.random.default_rng(8)
    data = [(f"v{i:02d}", list(map(float, rng.standard_normal(8).astype("f4")))) for i in range(60)]
    df = spark.createDataFrame(data, "id string, v array<float>")
    got = {(r.id, r["rank"]): (r.neighbour, r.cosine) for r in knn.nearest_vectors(df, "id", "v", 3).collect()}
    agree(got, brute_near(data, 3))


def test_near_searches_every_shard_at_every_size(spark):
    rng = np.random.default_rng(6)
    data = [(f"v{i:03d}", list(map(float, rng.standard_normal(16)))) for i in range(400)]
    agree(near(spark, data, shard_rows=25), brute_near(data, 3))


def brute_least(data, k, least):
    return {x: c for x, c in brute_near(data, k).items() if c[1] >= least}


def planted(n, dims, seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims))
    v[n // 2 :] = v[: n - n // 2] + rng.uniform(0.02, 0.33, (n - n // 2, 1)) * rng.standard_normal((n - n // 2, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("dims, least", [(1, 0.95), (2, 0.95), (3, 0.5), (32, 0.95)])
def test_near_of_a_least_cosine(spark, dims, least):
    data = [(f"v{i:03d}", list(map(float, x))) for i, x in enumerate(planted(600, dims, 11))]
    data += [(f"c{i}", data[5][1]) for i in range(8)] + [("n1", [NAN] * dims), ("n2", [0.0] * dims)]
    want = brute_least(data, 5, least)
    agree(near(spark, data, 5, least=least), want)
    assert want and near(spark, [], least=least) == {}


def test_near_of_a_least_cosine_in_several_passes(spark, monkeypatch):
    """Copies with noise go by id; the small bounds make a task read the cells often and sort out often."""
    rng = np.random.default_rng(7)
    mid = rng.standard_normal(16)
    data = [(f"v{i:04d}", list(map(float, mid + 1e-5 * rng.standard_normal(16) if i % 3 == 0 else rng.standard_normal(16)))) for i in range(900)]
    q = np.array([v for _, v in data])
    ids = pa.array([i for i, _ in data])
    u = knn.unit(q)
    want = brute_least(data, 5, 0.95)
    monkeypatch.setattr(cells, "HELD", 2000)
    best = cells.Best(u, 0.95, 6)
    for x in range(0, 900, 100):
        r, c = np.nonzero(u @ u[x : x + 100].T >= best.least[:, None])
        best.add(r, c, q[x : x + 100], ids[x : x + 100])
    got = {}
    for row, b in zip(*best.lists()):
        others = [y for y in b.as_py() if y["id"] != data[row][0]][:5]
        got |= {(data[row][0], r + 1): (y["id"], -y["d"]) for r, y in enumerate(others)}
    agree(got, want)
    agree(near(spark, data, 5, least=0.95), want)


def test_near_of_a_least_cosine_of_very_long_and_short_vectors(spark):
    data = [(f"v{i:02d}", list(map(float, x * [1.0, 1e-200, 1e200][i % 3]))) for i, x in enumerate(planted(60, 8, 13))]
    agree(near(spark, data, 5, least=0.95), brute_least([(i, list(np.array(v) / np.abs(v).max())) for i, v in data], 5, 0.95))


def test_near_of_a_least_cosine_visits_few_cells():
    """Four times the vectors are about twice the work of a query, and no pair of the asked cosine is lost."""
    work = []
    for n in (8000, 32_000):
        v = planted(n, 32, 12).astype("f4")
        centres = v[np.random.default_rng(1).choice(n, round((10 * n) ** 0.5), replace=False)]
        home = np.argmax(v @ centres.T, 1)
        row, cell = cells.visits(v[:1000], centres, 0.95)
        seen = np.zeros((1000, len(centres)), bool)
        seen[row, cell] = True
        r, c = np.nonzero(v[:1000] @ v.T >= 0.95)
        assert len(r) > 1500 and seen[r, home[c]].mean() > 0.999
        work.append(len(centres) + seen @ np.bincount(home, minlength=len(centres)))
    assert work[1].mean() < 2.6 * work[0].mean() and work[1].mean() < 0.12 * 32_000


def test_pairs_found_build_no_graph(spark, monkeypatch):
    """p3_found asks for cosines from 0.95, so its queries do not go through every shard."""
    monkeypatch.setattr(knn, "_build", None)
    monkeypatch.setattr(knn, "_search", None)
    assert graph_plans.p3_found(spark, "/root/testdata/sf0.001").count() > 50
