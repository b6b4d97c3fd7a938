"""Small graphs and matrices with results that can be checked by hand or with numpy."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.operators import community, correlate, entropy, expr, gcn, graph, linalg, mcl, motif, rank, report, traverse
from netspark.sources import counts, sinks


def make(spark, edges, n, both=True):
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src int, dst int, weight double")
    return graph.Graph(spark.range(n).select(F.col("id").cast("int").alias("idx")), graph.symmetrise(e) if both else e, symmetric=both)


def values(df, key, *cols):
    return {r[0]: (r[1] if len(cols) == 1 else tuple(r[1:])) for r in df.select(key, *cols).collect()}


def long(spark, rows):
    return spark.createDataFrame([(g, s, float(v)) for g, vs in rows.items() for s, v in enumerate(vs)], "gene int, sample int, value double")


def test_constant_gene_has_no_edge_and_identical_genes_exceed_one(spark):
    v = list(range(20))
    z = expr.zscore(long(spark, {0: v, 1: v, 2: [5] * 20}))
    assert values(z.where("gene = 2"), "sample", "z") == dict.fromkeys(range(20), 0.0)
    for f in (correlate.edges_by_join, correlate.edges_by_blocks):
        got = f(z, 20, 0.7).collect()
        assert [(r.src, r.dst) for r in got] == [(0, 1)]
        assert got[0].weight == pytest.approx(20 / 19)


def test_blocks_equal_the_join(spark):
    rng = np.random.default_rng(3)
    z = expr.zscore(long(spark, {g: rng.random(12) for g in range(40)}))
    a = {(r.src, r.dst): round(r.weight, 9) for r in correlate.edges_by_join(z, 12, 0.2).collect()}
    b = {(r.src, r.dst): round(r.weight, 9) for r in correlate.edges_by_blocks(z, 12, 0.2, block=7).collect()}
    assert a == b and len(a) > 20


def test_blocks_equal_the_join_with_missing_samples(spark):
    x = spark.createDataFrame([(g, s, float((g * 7 + s * s) % 13)) for g in range(2) for s in range(10) if s != g], "gene int, sample int, value double")
    a, b = (f(expr.zscore(x), 10, -2.0).first().weight for f in (correlate.edges_by_join, correlate.edges_by_blocks))
    assert a == pytest.approx(b)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        rows = [(g, f"s{s}", float(v) if rng.random() > 0.02 else None) for g in range(30) for s, v in enumerate(rng.random(9)) if rng.random() > 0.2 * seed]
        z = expr.zscore(spark.createDataFrame(rows, "gene int, sample string, value double"))
        a = {(r.src, r.dst): r.weight for r in correlate.edges_by_join(z, 9, 0.1).collect()}
        b = {(r.src, r.dst): r.weight for r in correlate.edges_by_blocks(z, 9, 0.1, block=[7, 64, 11][seed]).collect()}
        assert len(a) > 20 and a == pytest.approx(b)


def test_zero_library_and_filter_rounding(spark):
    x = long(spark, {0: [0, 2], 1: [0, 6]})
    assert values(expr.library_sizes(x), "sample", "lib_size") == {0: 1.0, 1: 8.0}
    c = expr.cpm(x)
    assert values(c.where("sample = 0"), "gene", "cpm") == {0: 0.0, 1: 0.0}
    seven = expr.cpm(long(spark, {0: [1, 0, 0, 0, 0, 0, 0], 1: [0] * 7, 2: [1] * 7}))
    assert set(values(expr.kept_genes(seven, 1.0, 0.2), "gene", "n_expressed")) == {0, 2}
    assert set(values(expr.kept_genes(seven, 1.0, 0.1), "gene", "n_expressed")) == {0, 1, 2}


def test_clean_edges(spark):
    e = spark.createDataFrame([(2, 1, 0.5, 1, 1), (1, 2, 0.7, 2, 1), (1, 1, 1.0, 1, 1), (None, 1, 1.0, 1, 1), (3, 4, float("nan"), 1, 1), (3, 4, None, 3, 3)], "src int, dst int, weight float, computed_at int, loaded_at int")
    assert [(r.src, r.dst, round(r.weight, 6)) for r in graph.clean_edges(e).collect()] == [(1, 2, 0.7)]


def test_bfs_isolated_and_direction(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 1)], 4)
    assert values(traverse.bfs(g, [0]), "idx", "dist") == {0: 0, 1: 1, 2: 2, 3: -1}
    d = make(spark, [(0, 1, 1), (1, 2, 1)], 3, both=False)
    assert values(traverse.bfs(d, [2]), "idx", "dist") == {0: -1, 1: -1, 2: 0}
    assert values(traverse.bfs(d, [2], direction="in"), "idx", "dist") == {0: 2, 1: 1, 2: 0}
    path = make(spark, [(i, i + 1, 1) for i in range(13)] + [(0, 5, 1)], 14)
    assert values(traverse.bfs(path, [0]), "idx", "dist") == {i: min(i, abs(i - 5) + 1) for i in range(14)}
    assert values(traverse.bfs(path, [0], max_levels=2), "idx", "dist")[3] == -1
    assert values(traverse.bfs(g, [99]), "idx", "dist") == dict.fromkeys(range(4), -1)


def test_random_sources():
    assert traverse.random_sources(500) == [42, 380, 43, 322, 216, 214, 347, 47, 100, 425]


def test_pagerank_path(spark):
    g = make(spark, [(i, i + 1, 1) for i in range(4)], 5)
    x = values(rank.pagerank(g, max_iter=25, tol=None), "idx", "x")
    assert sum(x.values()) == pytest.approx(1.0)
    a = np.zeros((5, 5))
    for i in range(4):
        a[i, i + 1] = a[i + 1, i] = 1
    p, v = a / a.sum(1, keepdims=True), np.full(5, 0.2)
    for _ in range(25):
        v = 0.85 * p.T @ v + 0.03
    assert [x[i] for i in range(5)] == pytest.approx(list(v))
    bad = values(rank.pagerank(g, max_iter=3, tol=None, compat=True), "idx", "x")
    assert sum(bad.values()) > 1.05


def test_pagerank_stops_and_keeps_mass_with_dangling(spark):
    g = make(spark, [(0, 1, 2), (1, 2, 1)], 4, both=False)
    x = values(rank.pagerank(g, tol=1e-3), "idx", "x")
    assert sum(x.values()) == pytest.approx(1.0) and x[2] > x[1] > x[0] == pytest.approx(x[3])


def test_rwr(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 1)], 4)
    assert values(rank.rwr(g, [3, 3], max_iter=3, tol=None), "idx", "x")[3] == pytest.approx(0.15)
    one = values(rank.rwr(g, [0, 2], max_iter=5, tol=None), "idx", "x")
    each = values(rank.rwr_each(g, [0, 2], steps=5).groupBy("idx").agg((F.sum("x") / 2).alias("x")), "idx", "x")
    assert all(each.get(i, 0) == pytest.approx(v) for i, v in one.items())
    assert sum(one.values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        rank.rwr(g, [])


def test_hits_star(spark):
    x = values(rank.hits(make(spark, [(0, i, 1) for i in (1, 2, 3)], 4, both=False), max_iter=5), "idx", "hub", "authority")
    assert x[0] == pytest.approx((1.0, 0.0))
    assert all(x[i] == pytest.approx((0.0, 1 / math.sqrt(3))) for i in (1, 2, 3))


def _entropy(x, y, bins=10):
    xb = np.clip(np.digitize(x, np.linspace(x.min(), x.max() + 1e-8, bins + 1)) - 1, 0, bins - 1)
    h = 0.0
    for b in range(bins):
        s = y[xb == b]
        if len(s) < 2:
            continue
        c = np.histogram(s, bins)[0]
        p = c[c > 0] / c.sum()
        h += len(s) / len(y) * -(p * np.log2(p)).sum()
    return h


def test_entropy_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = {g: rng.random(60) for g in range(4)} | {4: np.full(60, 2.0)}
    x = long(spark, m)
    got = {(r.regulator, r.target): r.h for r in entropy.conditional_entropy(x, x.select("gene").distinct()).collect()}
    assert all(got[a, b] == pytest.approx(_entropy(m[a], m[b]), abs=1e-9) for a in m for b in m if a != b)
    assert got[0, 4] == 0.0
    score = values(entropy.mce(x, x.where("gene = 1").select("gene").distinct()), "gene", "mce_score")
    assert score == {1: pytest.approx(sum(got[1, b] for b in m if b != 1) / 4)}


def test_entropy_by_blocks_is_the_join_with_missing_samples(spark):
    rng = np.random.default_rng(1)
    x = long(spark, {g: np.round(rng.random(30), 1) for g in range(12)} | {12: [2.0] * 30}).where("pmod(gene * 7 + sample, 11) > 0")
    every = x.select("gene").distinct()
    want = {(r.regulator, r.target): r.h for r in entropy.conditional_entropy(x, every).collect()}
    got = {(r.regulator, r.target): r.h for r in entropy.entropy_by_blocks(x, block=5).collect()}
    assert len(want) == 13 * 12 and got == pytest.approx(want, abs=1e-9)
    mean = {a: sum(h for (r, _), h in want.items() if r == a) / 12 for a, _ in want}
    assert values(entropy.mce_all(x), "gene", "mce_score") == pytest.approx(mean)
    assert values(entropy.mce(x, every), "gene", "mce_score") == pytest.approx(mean)


def test_top_regulator_beyond_the_first_fifty(spark, tmp_path):
    from netspark.plans import network

    rng = np.random.default_rng(2)
    steps = lambda g, m: 2.0 ** ((m * 7 + g) % 24 / 2)  # noqa: E731  evenly spread over the bins, while the first 50 are flat but for a month
    rows = [(g, m, float(steps(g, m) if g >= 50 else 1e4 if m == 0 else 90 + rng.integers(9))) for g in range(60) for m in range(24)]
    li = spark.createDataFrame(rows, "l_suppkey int, m int, l_quantity double")
    li.selectExpr("l_suppkey", "add_months(date'2020-01-01', m) l_shipdate", "l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = values(network.mce_all(spark, str(tmp_path)), "gene", "mce_score")
    assert len(got) == 60
    assert network.top_regulator_all(spark, str(tmp_path)).first().gene == min(got, key=lambda g: (got[g], g)) >= 50


def test_triangles(spark):
    tri = [(0, 1, 1), (1, 2, 1), (0, 2, 1)]
    assert values(motif.motifs(make(spark, tri, 3)), "idx", "triangles", "clustering_coeff", "degree") == dict.fromkeys(range(3), (1, 1.0, 2))
    half = motif.motifs(make(spark, [(a, b, 0.5) for a, b, _ in tri], 3))
    assert values(half, "idx", "triangles", "clustering_coeff", "degree") == dict.fromkeys(range(3), (0, 0.125, 1))
    t = motif.motif_totals(motif.motifs(make(spark, tri, 4), False)).first()
    assert (t.total_triangles, t.avg_clustering) == (1, 0.75)


def two_triangles(spark):
    return make(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)], 6)


def test_mcl_two_clusters(spark):
    g = two_triangles(spark)
    m = mcl.mcl(g, max_iter=4)
    assert all(v == pytest.approx(1.0) for v in values(m.groupBy("col").agg(F.sum("val").alias("s")), "col", "s").values())
    c = values(mcl.mcl_clusters(m, g.vertices), "idx", "community")
    assert c[0] == c[1] == c[2] != c[3] == c[4] == c[5]


def test_mcl_clusters_every_vertex_of_a_larger_graph(spark):
    n = 1001  # triangles, so 3,003 vertices
    g = make(spark, [(3 * t + i, 3 * t + j, 1) for t in range(n) for i, j in ((0, 1), (1, 2), (0, 2))], 3 * n)
    m = mcl.mcl(g, max_iter=2, tol=None)
    assert m.select("col").distinct().count() == 3 * n
    assert values(mcl.mcl_clusters(m, g.vertices), "idx", "community") == {v: v - v % 3 for v in range(3 * n)}


def test_louvain_and_modularity(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 0.1)], 7)
    c = values(community.louvain(g), "idx", "community")
    assert c[0] == c[1] == c[2] != c[3] == c[4] == c[5] and c[6] == 6
    q = community.modularity(g, g.vertices.select("idx", F.expr("if(idx < 3, 0, if(idx < 6, 1, 2))").alias("community"))).first()
    assert q.communities == 3 and q.modularity == pytest.approx(6 / 6.1 - 0.5)


def test_gcn_default_features_give_one_vector(spark):
    e = [r.emb for r in gcn.gcn(two_triangles(spark)).collect()]
    assert np.ptp(np.array(e), axis=0).max() < 1e-9 and np.linalg.norm(e[0]) == pytest.approx(1.0)


def test_top_subgraph_keeps_labels(spark):
    g = make(spark, [(0, 9, 5), (8, 9, 4), (1, 2, 1)], 10)
    sub, pos = graph.top_subgraph(g, 3)
    assert values(pos, "idx", "pos") == {0: 0, 8: 1, 9: 2}
    assert sub.edges.count() == 4


def test_linalg(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (1, 1, 1.0)], "row int, col int, val double")
    assert {(r.row, r.col): r.val for r in linalg.spgemm(m, m).collect()} == {(0, 0): 6.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 7.0}
    rng = np.random.default_rng(1)
    x = (rng.random((60, 60)) < 0.4) * rng.standard_normal((60, 60))
    x[:, 7] = 1.0  # a heavy inner index
    x[7] = 1.0
    i, j = np.nonzero(x)
    m = spark.createDataFrame([(int(a) * 3, int(b) * 3, float(x[a, b])) for a, b in zip(i, j)], "row int, col int, val double")
    for products in (10, 500, 1 << 22):  # blocks, split and plain joins
        got = np.zeros((60, 60))
        for r in linalg.spgemm(m, m, products).collect():
            got[r.row // 3, r.col // 3] = r.val
        assert got == pytest.approx(x @ x)
    got = np.zeros((60, 60))
    for r in linalg._by_blocks(m.selectExpr("row", "col k", "val va"), m.selectExpr("row k", "col", "val vb"), 60, 60, 16).collect():
        got[r.row // 3, r.col // 3] += r.val
    assert got == pytest.approx(x @ x)
    zero = spark.createDataFrame([(0, 0, 0.0)], "row int, col int, val double")
    assert linalg.normalise(zero, "row").first().val == 0.0


def test_reports_round_half_even(spark, tmp_path):
    s = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "algorithm string, seconds double")
    p = spark.createDataFrame([("a", 0.4), ("c", 1.0)], "algorithm string, seconds double")
    r = values(report.speedup_report(s, p, 8), "algorithm", "speedup_x", "efficiency_pct")
    assert r == {"a": (2.5, 31.2), "b": (None, None), "c": (None, None)}
    text = values(report.printed(report.speedup_report(s, p, 8)), "algorithm", "parallel_time_s", "speedup_x")
    assert text["b"] == ("N/A", "N/A") and text["a"] == ("0.4000", "2.50x")
    df, secs = report.timed(lambda: s, str(tmp_path / "s"))
    assert secs > 0 and df.count() == 2


def test_sources_and_sinks(spark, tmp_path):
    wide = spark.createDataFrame([("g1", 1.0, 2.0), ("g2", 3.0, 4.0), ("g3", 5.0, 6.0)], "gene_name string, s1 double, s2 double").coalesce(1)
    wide.write.parquet(str(tmp_path / "w"))
    assert counts.detect_id_column(wide.schema) == "gene_name"
    pre = counts.row_prefix(spark, str(tmp_path / "w"), 2)
    assert values(expr.library_sizes(counts.to_long(pre.drop("row_idx"))), "sample", "lib_size") == {"s1": 4.0, "s2": 6.0}
    assert counts.inspect_parquet(spark, str(tmp_path / "w")).first().rows == 3
    np.save(tmp_path / "a.npy", np.array([[1.0, 0.0], [0.0, 2.0]]))
    assert counts.from_npy(spark, str(tmp_path / "a.npy")).agg(F.sum("value")).first()[0] == 3.0
    scores = spark.createDataFrame([(0, 0.1), (1, 0.9), (2, 0.9)], "idx int, x double")
    genes = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, gene_id string")
    sinks.save_scores(scores, genes, str(tmp_path / "s"), "x")
    assert [r[0] for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()] == ["b", "2", "a"]
    made = []
    for _ in range(2):
        sinks.stage(spark, str(tmp_path / "st"), lambda: made.append(1) or scores)
    assert len(made) == 1


def test_half_of_a_wide_gene_axis(spark, tmp_path):
    from netspark.plans import network

    axis = [7 * k * k + 5_000 for k in range(1_001)]  # not dense, all above 1,500
    spark.createDataFrame([(v,) for v in axis] + [(None,)], "gene_idx int").write.parquet(str(tmp_path / "genes_filtered.parquet"))
    ends = list(zip(axis, axis[1:]))
    spark.createDataFrame([(a, b, 0.5, 1, 1) for a, b in ends], "src int, dst int, weight double, computed_at int, loaded_at int").write.parquet(str(tmp_path / "edge_list.parquet"))
    assert {(r.src, r.dst) for r in network.n_genes_half(spark, str(tmp_path)).collect()} == set(ends[:499])
    odd = spark.createDataFrame([(v,) for v in (-9, 3, 3, 2**31 - 1, -(2**31))], "v int")
    assert [counts.nth_smallest(odd, "v", n) for n in range(5)] == [-(2**31), -9, 3, 3, 2**31 - 1]
    spark.range(5_000).selectExpr("id l_orderkey", "1 l_linenumber").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(r.row_idx for r in network.max_genes_half(spark, str(tmp_path)).collect()) == list(range(2_500))


def test_best_of_restarts(spark):
    g = two_triangles(spark)
    best = community.best_louvain(g, restarts=2)
    assert community.modularity(g, best).first().modularity == pytest.approx(0.5)


def test_random_graph_against_numpy(spark):
    n, rng = 100, np.random.default_rng(42)
    a = np.zeros((n, n))
    for i, j, w in zip(rng.integers(0, n, 300), rng.integers(0, n, 300), rng.uniform(0.5, 1.0, 300)):
        a[i, j] += w
    a = a + a.T
    np.fill_diagonal(a, 0)
    i, j = np.nonzero(np.triu(a))
    g = make(spark, [(int(x), int(y), a[x, y]) for x, y in zip(i, j)], n)
    dist = np.full(n, -1)
    dist[0], front, level = 0, {0}, 0
    while front:
        level += 1
        front = {int(k) for f in front for k in np.flatnonzero(a[f]) if dist[k] < 0}
        dist[list(front)] = level
    assert values(traverse.bfs(g, [0]), "idx", "dist") == dict(enumerate(dist))
    out = a.sum(1)
    p = a / np.where(out == 0, 1, out)[:, None]
    x = np.full(n, 1 / n)
    for _ in range(6):
        x = 0.85 * (p.T @ x) + 0.15 / n + 0.85 * x[out == 0].sum() / n
    got = values(rank.pagerank(g, tol=None, max_iter=6), "idx", "x")
    assert [got[k] for k in range(n)] == pytest.approx(list(x))
    h = np.ones(n)
    for _ in range(3):
        u = a.T @ h
        u /= np.linalg.norm(u)
        h = a @ u
        h /= np.linalg.norm(h)
    got = values(rank.hits(g, tol=None, max_iter=3), "idx", "hub", "authority")
    assert np.array([got[k] for k in range(n)]) == pytest.approx(np.c_[h, u])
    t = np.diag(a @ a @ a) / 2
    got = values(motif.motifs(g), "idx", "triangles")
    assert [got[k] for k in range(n)] == [int(v + 1e-12) for v in t]


@pytest.fixture
def no_small_tables(monkeypatch):
    """Every vector counts as large: edges in buckets, hot vertices apart."""
    for m in (graph, traverse, linalg):
        monkeypatch.setattr(m, "SMALL_BYTES", 0)


def test_large_vectors_give_the_same(spark, no_small_tables):
    test_random_graph_against_numpy(spark)
    test_rwr(spark)
    test_louvain_and_modularity(spark)
    test_bfs_isolated_and_direction(spark)
    test_mcl_two_clusters(spark)


def test_no_step_moves_the_edges(spark, monkeypatch):
    from netspark.workspace import Workspace

    n = 2000
    e = spark.range(20_000).selectExpr("int(pmod(id * 7919, 2000)) src", "int(pmod(id * 104729 + 13, 2000)) dst", "1.0D weight").where("src <> dst")
    g = graph.Graph(spark.range(n).selectExpr("int(id) idx"), e, symmetric=False)
    x = spark.range(n).selectExpr("int(id) idx", "1.0D v")
    small = graph.Spread(Workspace(spark, "plan"), "a", e, g.hot)
    plan = small.meet(x)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(graph, "SMALL_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = graph.Spread(Workspace(spark, "plan"), "b", e, [0, 1])
        plan = large.meet(x)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning") == 1  # the vector's; the edges lie in buckets
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    assert large.meet(x).count() == e.count()


def test_by_tolerance_against_numpy(spark):
    n, rng = 40, np.random.default_rng(3)
    a = np.triu((rng.random((n, n)) < 0.15) * rng.uniform(0.5, 1.0, (n, n)), 1)
    i, j = np.nonzero(a)
    a = a + a.T
    g = make(spark, [(int(x), int(y), a[x, y]) for x, y in zip(i, j)], n)
    p = a / np.where(a.sum(1) == 0, 1, a.sum(1))[:, None]
    x = np.full(n, 1 / n)
    for _ in range(200):
        x = 0.85 * (p.T @ x) + 0.15 / n + 0.85 * x[a.sum(1) == 0].sum() / n
    got = values(rank.pagerank(g), "idx", "x")
    assert [got[k] for k in range(n)] == pytest.approx(list(x), abs=1e-5)
    y = p0 = np.eye(n)[0]
    for _ in range(200):
        y = 0.85 * (p.T @ y) + 0.15 * p0
    got = values(rank.rwr(g, [0]), "idx", "x")
    assert [got[k] for k in range(n)] == pytest.approx(list(y), abs=1e-5)
    w, v = np.linalg.eigh(a @ a.T)
    got = values(rank.hits(g, tol=1e-4), "idx", "hub")
    assert [got[k] for k in range(n)] == pytest.approx(list(np.abs(v[:, -1])), abs=0.02)


def test_source_vertices_of_a_sparse_axis(spark):
    v = spark.createDataFrame([(7 * k + 3,) for k in range(500)], "idx int")
    assert traverse.source_vertices(v) == [7 * k + 3 for k in traverse.random_sources(500)]
    assert traverse.source_vertices(v.limit(0)) == []


def test_hot_keys_by_rows_and_bounded(spark, monkeypatch):
    from netspark.operators import lookup

    c = spark.createDataFrame([(k, 10 * k) for k in range(1, 101)], "k int, n long")
    monkeypatch.setattr(lookup, "HOT_ROWS", 800)
    assert sorted(lookup.hot_keys(c, "k", "n", 50_500, 0.9)) == list(range(80, 101))
    monkeypatch.setattr(lookup, "MAX_HOT", 51)
    assert len(lookup.hot_keys(c, "k", "n", 50_500, 0.9)) <= 51


def test_pagerank_of_a_held_graph_is_no_job_a_step(spark, monkeypatch):
    g = make(spark, [(k, (k * 7 + 1) % 50, 1 + k % 3) for k in range(40)] + [(0, 60, 1.0)], 55)  # 60 is no vertex, 51 to 54 are isolated
    spark.sparkContext.setJobGroup("pagerank-held", "")
    got = values(rank.pagerank(g, tol=None, max_iter=8), "idx", "x")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pagerank-held"))
    spark.sparkContext.setJobGroup("pagerank-loop", "")
    monkeypatch.setattr(rank, "WHOLE_EDGES", 0)
    want = values(rank.pagerank(g, tol=None, max_iter=8), "idx", "x")
    assert set(got) == set(range(55)) and got == pytest.approx(want, abs=1e-12)
    assert jobs + 8 <= len(spark.sparkContext.statusTracker().getJobIdsForGroup("pagerank-loop"))
    monkeypatch.undo()
    assert values(rank.pagerank(g, tol=None, max_iter=3, compat=True), "idx", "x").keys() == got.keys()
    assert rank.pagerank(graph.Graph(g.vertices.limit(0), g.edges.limit(0))).collect() == []


def test_entropy_counted_in_words_is_the_plain_count():
    rng = np.random.default_rng(5)
    for samples in (1, 9, 84, 900):  # 900: slices of more samples than a word counts
        y = np.round(rng.random((40, samples)) * 8) / 4
        y[0], y[1, : samples // 2] = 1.0, 0.0
        x = y[:6].copy()
        x[5, ::3] = np.nan  # a regulator without some samples
        x = x[~np.isnan(x).all(1)]
        got = entropy._block(x, y, 10)
        assert got == pytest.approx(np.stack([entropy._entropies(row, y, 10) for row in x]), abs=1e-12)


def test_entropy_of_copies_is_scored_once_a_vector(spark):
    rng = np.random.default_rng(9)
    kinds = np.round(rng.random((3, 12)) * 4)
    m = kinds[[0] * 9 + [1] * 4 + [2]]
    distinct, kind = entropy._kinds(m)
    assert len(distinct) == 3 and (distinct[kind] == m).all()
    x = long(spark, dict(enumerate(m)))
    every = x.select("gene").distinct()
    want = {(r.regulator, r.target): r.h for r in entropy.conditional_entropy(x, every).collect()}
    for block in (None, 4):  # 4: the nine copies are more than a block and lie in several
        got = {(r.regulator, r.target): r.h for r in entropy.entropy_by_blocks(x, block=block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    sums = values(entropy.entropy_by_blocks(x, sums=True), "gene", "s")
    assert sums == pytest.approx({g: sum(h for (r, _), h in want.items() if r == g) for g in range(14)}, abs=1e-9)


def test_entropy_block_moves_each_vector_a_few_times(spark):
    x = spark.range(6000).selectExpr("int(id div 3) gene", "int(id % 3) sample", "double(pmod(id * 7919, 11)) value")
    plan = entropy.entropy_by_blocks(x)._jdf.queryExecution().analyzed().toString()
    rows = [int(m) + 1 for m in re.findall(r"explode\(sequence\(0, (\d+)", plan)]  # of a vector, on either side
    assert len(rows) == 2 and max(rows) <= 4, plan  # blocks of 256 genes were 8
    assert entropy.entropy_by_blocks(x, x.where("gene < 2").select("gene").distinct()).count() == 2 * 1999


def test_top_regulator_of_copies_is_the_smallest_id(spark):
    rng = np.random.default_rng(2)
    m = np.round(rng.random((4, 12)) * 4)[[3, 0, 1, 2, 0, 1, 2, 3] * 40]  # 320 genes, 80 of each vector
    got = entropy.mce_all(long(spark, dict(enumerate(m)))).select("gene", F.round("mce_score", 6).alias("mce_score")).orderBy("mce_score", "gene").collect()
    assert len(got) == 320 and len({r.mce_score for r in got}) <= 4
    best = entropy._block(m[:4], m, 10).sum(1) - np.diag(entropy._block(m[:4], m[:4], 10))
    assert got[0].gene == int(best.argmin()) and got[0].mce_score == pytest.approx(best.min() / 319, abs=1e-6)


def test_entropies_of_all_pairs_are_rounded_in_the_task(spark, tmp_path):
    from netspark.plans import network

    rng = np.random.default_rng(4)
    x = long(spark, dict(enumerate(np.round(rng.random((7, 12)) * 4)[[0, 1, 2, 3, 4, 5, 6, 0, 0, 3]])))
    want = {(r.regulator, r.target): r.h for r in entropy.conditional_entropy(x, x.select("gene").distinct()).collect()}
    for block in (None, 3):  # 3: blocks without a gene's own rows
        got = {(r.regulator, r.target): r.h for r in entropy.entropy_by_blocks(x, block=block, digits=6).collect()}
        assert got.keys() == want.keys() and all(got[k] == round(got[k], 6) == pytest.approx(want[k], abs=1e-6) for k in want)
    odd = entropy._rounded(np.array([-1e-17, 0.0, 0.5, 1.2345675, 2.0000004999, np.nan]), 6)
    assert odd[:5].tolist() == [0.0, 0.0, 0.5, 1.234568, 2.0] and not np.signbit(odd[0]) and np.isnan(odd[5])
    spark.range(2400).selectExpr("id % 6 l_suppkey", "timestamp'2020-01-01' + make_dt_interval(int(id % 300)) l_shipdate", "double(pmod(id * 7919, 50)) l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = network.cond_entropy_pairs_all(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "round(" not in plan, plan


def test_entropy_counts_three_samples_a_lookup(monkeypatch):
    rng = np.random.default_rng(6)
    looked = []
    monkeypatch.setattr(entropy.np, "take", lambda a, i, *r, **k: looked.append((len(a), np.shape(i))) or a.take(i, *r, **k))
    for samples in (2, 3, 4, 5, 61, 62, 63, 64, 130):  # one slice, with and without samples left over from the threes
        y = np.round(rng.random((30, samples)) * 40) / 8
        y[0], y[1], y[2] = 3.0, np.arange(samples) * 5e-324, np.arange(samples) * 1e-322  # constant, and ranges too small for a quotient
        looked.clear()
        got = entropy._Targets(np.ascontiguousarray(y.T), 10).given(np.ones(samples))
        assert got == pytest.approx(entropy._entropies(np.ones(samples), y, 10), abs=1e-12)
        rows = sum(shape[0] for size, shape in looked if size == 12**3)
        assert rows == sum(-(-min(63, samples - a) // 3) for a in range(0, samples, 63))  # one a sample before
