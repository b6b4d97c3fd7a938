"""The SQL of the network queries, in DuckDB's dialect."""

from __future__ import annotations

import numpy as np

from netspark.plans.network import EMB, SEEDS, STEPS

_GRID = """q AS (SELECT l_suppkey AS gene, strftime(l_shipdate, '%Y-%m') AS sample, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 grid AS MATERIALIZED (SELECT g.gene, s.sample, coalesce(q.v, 0) AS value FROM (SELECT DISTINCT gene FROM q) g CROSS JOIN (SELECT DISTINCT sample FROM q) s LEFT JOIN q ON q.gene = g.gene AND q.sample = s.sample),
 lib AS (SELECT sample, CASE WHEN sum(value) = 0 THEN 1.0 ELSE sum(value) END AS lib_size FROM grid GROUP BY sample),
 c AS (SELECT gene, sample, value / lib_size * 1e6 AS cpm FROM grid JOIN lib USING (sample)),
 x AS MATERIALIZED (SELECT gene, sample, log2(cpm + 1) AS value FROM c)"""
_EMBX = "x AS MATERIALIZED (SELECT vec_id AS gene, generate_subscripts(embedding, 1) AS sample, unnest(embedding)::DOUBLE AS value FROM embeddings)"
_Z = "z AS MATERIALIZED (SELECT gene, sample, (value - avg(value) OVER (PARTITION BY gene)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY gene) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY gene) END AS z FROM x)"
_PAIR = "r AS MATERIALIZED (SELECT a.gene AS src, b.gene AS dst, sum(a.z * b.z) / ((SELECT count(DISTINCT sample) FROM x) - 1) AS weight FROM z a JOIN z b ON a.sample = b.sample AND a.gene < b.gene GROUP BY 1, 2)"
_GRIDR = f"{_GRID}, {_Z}, {_PAIR}"
_EMBR = f"{_EMBX}, {_Z}, {_PAIR}"
_G = """cand AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight::DOUBLE AS weight, computed_at, loaded_at, CASE WHEN isnan(weight::DOUBLE) THEN 1 ELSE 0 END AS bad FROM edge_list WHERE src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL AND src <> dst),
 e AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY computed_at DESC, loaded_at DESC, weight DESC) AS rn FROM cand WHERE bad = 0) WHERE rn = 1),
 s AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
 v AS MATERIALIZED (SELECT DISTINCT idx FROM (SELECT gene_idx AS idx FROM genes_filtered UNION ALL SELECT src FROM s) WHERE idx IS NOT NULL)"""
_DEG = "d AS MATERIALIZED (SELECT v.idx, count(s.src) AS degree, coalesce(sum(s.weight), 0) AS weighted_degree FROM v LEFT JOIN s ON s.src = v.idx GROUP BY v.idx)"
_EMBG = f"{_EMBR}, e AS MATERIALIZED (SELECT * FROM r WHERE weight >= {EMB}), s AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), v AS MATERIALIZED (SELECT DISTINCT vec_id AS idx FROM embeddings)"
_BFS = """WITH RECURSIVE {g},
 b(source, idx, dist) USING KEY (source, idx) AS (
  SELECT idx, idx, 0 FROM v WHERE idx IN ({seeds})
  UNION
  SELECT b.source, s.dst, min(b.dist + 1) FROM b JOIN s ON s.src = b.idx LEFT JOIN recurring.b o ON o.source = b.source AND o.idx = s.dst WHERE o.idx IS NULL GROUP BY 1, 2),
 f AS (SELECT t.source, v.idx, coalesce(b.dist, -1)::INTEGER AS dist FROM v CROSS JOIN (SELECT unnest([{seeds}])::INTEGER AS source) t LEFT JOIN b ON b.source = t.source AND b.idx = v.idx)
"""


def _pagerank(steps: int, unit: bool) -> str:
    w = "1.0::DOUBLE" if unit else "weight"
    loose = "o.out IS NULL OR o.out = 1.0" if unit else "o.out IS NULL"
    sql = f"WITH {_G}, su AS MATERIALIZED (SELECT src, dst, {w} AS weight FROM s), o AS MATERIALIZED (SELECT src, sum(weight) AS out FROM su GROUP BY src), p AS MATERIALIZED (SELECT su.src, su.dst, su.weight / o.out AS p FROM su JOIN o ON o.src = su.src), n AS (SELECT count(*)::DOUBLE AS n FROM v), x0 AS MATERIALIZED (SELECT v.idx, 1.0 / n AS x, ({loose}) AS dangling FROM v CROSS JOIN n LEFT JOIN o ON o.src = v.idx)"
    for i in range(1, steps + 1):
        sql += f", x{i} AS MATERIALIZED (SELECT x.idx, 0.85 * coalesce(y.y, 0) + 0.15 / n + 0.85 * coalesce((SELECT sum(x) FROM x{i - 1} WHERE dangling), 0) / n AS x, x.dangling FROM x{i - 1} x CROSS JOIN n LEFT JOIN (SELECT p.dst, sum(p.p * x.x) AS y FROM p JOIN x{i - 1} x ON x.idx = p.src GROUP BY p.dst) y ON y.dst = x.idx)"
    return sql + f" SELECT idx, round(x, 9) AS pagerank FROM x{steps}"


def _rwr(steps: int) -> str:
    seeds = ", ".join(map(str, SEEDS))
    sql = f"WITH {_G}, o AS MATERIALIZED (SELECT src, sum(weight) AS out FROM s GROUP BY src), p AS MATERIALIZED (SELECT s.src, s.dst, s.weight / o.out AS p FROM s JOIN o ON o.src = s.src), x0 AS MATERIALIZED (SELECT idx, CASE WHEN idx IN ({seeds}) THEN 1.0::DOUBLE / {len(SEEDS)} ELSE 0.0 END AS x, CASE WHEN idx IN ({seeds}) THEN 1.0::DOUBLE / {len(SEEDS)} ELSE 0.0 END AS p0 FROM v)"
    for i in range(1, steps + 1):
        sql += f", x{i} AS MATERIALIZED (SELECT x.idx, 0.85 * coalesce(y.y, 0) + 0.15 * p0 AS x, p0 FROM x{i - 1} x LEFT JOIN (SELECT p.dst, sum(p.p * x.x) AS y FROM p JOIN x{i - 1} x ON x.idx = p.src GROUP BY p.dst) y ON y.dst = x.idx)"
    return sql


def _hits(steps: int) -> str:
    sql = f"WITH {_G}, h0 AS MATERIALIZED (SELECT idx, 1.0::DOUBLE AS h FROM v)"
    for i in range(1, steps + 1):
        sql += f", ra{i} AS MATERIALIZED (SELECT v.idx, coalesce(sum(e.weight * h.h), 0) AS a FROM v LEFT JOIN e ON e.dst = v.idx LEFT JOIN h{i - 1} h ON h.idx = e.src GROUP BY v.idx), a{i} AS MATERIALIZED (SELECT idx, a / (SELECT CASE WHEN sum(a * a) = 0 THEN 1 ELSE sqrt(sum(a * a)) END FROM ra{i}) AS a FROM ra{i})"
        sql += f", rh{i} AS MATERIALIZED (SELECT v.idx, coalesce(sum(e.weight * a.a), 0) AS h FROM v LEFT JOIN e ON e.src = v.idx LEFT JOIN a{i} a ON a.idx = e.dst GROUP BY v.idx), h{i} AS MATERIALIZED (SELECT idx, h / (SELECT CASE WHEN sum(h * h) = 0 THEN 1 ELSE sqrt(sum(h * h)) END FROM rh{i}) AS h FROM rh{i})"
    return sql + f" SELECT h.idx, round(h.h, 8) + 0.0 AS hub, round(a.a, 8) + 0.0 AS authority FROM h{steps} h JOIN a{steps} a ON a.idx = h.idx"


def _mcl(steps: int) -> str:
    sql = f"WITH {_EMBG}, t0 AS (SELECT src AS row, dst AS col, weight AS val FROM s UNION ALL SELECT idx, idx, 1.0 FROM v), m0 AS MATERIALIZED (SELECT row, col, val / sum(val) OVER (PARTITION BY col) AS val FROM t0)"
    for i in range(1, steps + 1):
        sql += f", p{i} AS MATERIALIZED (SELECT a.row, b.col, sum(a.val * b.val) AS val FROM m{i - 1} a JOIN m{i - 1} b ON a.col = b.row GROUP BY 1, 2), i{i} AS MATERIALIZED (SELECT row, col, val * val / sum(val * val) OVER (PARTITION BY col) AS val FROM p{i}), f{i} AS MATERIALIZED (SELECT * FROM i{i} WHERE val >= 1e-4), m{i} AS MATERIALIZED (SELECT row, col, val / sum(val) OVER (PARTITION BY col) AS val FROM f{i})"
    return sql


_REGS = "reg AS (SELECT DISTINCT gene FROM x ORDER BY gene LIMIT 50)"
_MCE = f"""WITH {_GRID}, {_REGS},
 xr AS (SELECT gene AS regulator, sample, value AS v, min(value) OVER (PARTITION BY gene) AS lo, max(value) OVER (PARTITION BY gene) + 1e-8 AS hi, count(*) OVER (PARTITION BY gene) AS n FROM x WHERE gene IN (SELECT gene FROM reg)),
 xb AS MATERIALIZED (SELECT regulator, sample, n, least(floor((v - lo) / ((hi - lo) / 10)), 9)::INTEGER AS xb FROM xr),
 p AS (SELECT xb.*, x.gene AS target, x.value AS y FROM xb JOIN x ON x.sample = xb.sample AND x.gene <> xb.regulator),
 w AS (SELECT *, min(y) OVER k AS lo, max(y) OVER k AS hi, count(*) OVER k AS nb FROM p WINDOW k AS (PARTITION BY regulator, target, xb)),
 yb AS (SELECT regulator, target, xb, n, nb, CASE WHEN hi = lo THEN 0 ELSE least(floor((y - lo) / ((hi - lo) / 10)), 9) END AS yb FROM w),
 cells AS (SELECT regulator, target, xb, n, nb, yb, count(*) AS c FROM yb GROUP BY ALL),
 h AS (SELECT regulator, target, sum(CASE WHEN nb >= 2 THEN -(c / nb) * log2(c / nb) * nb / n ELSE 0 END) AS h FROM cells GROUP BY 1, 2)
"""
_MCES = _MCE + ", m AS (SELECT regulator AS gene, round(sum(h) / ((SELECT count(DISTINCT gene) FROM x) - 1), 6) + 0.0 AS mce_score FROM h GROUP BY 1)"

#: every gene as a regulator
_MCE_ALL, _MCES_ALL = (q.replace(_REGS, "reg AS (SELECT DISTINCT gene FROM x)") for q in (_MCE, _MCES))


def _motif(graph: str, weighted: bool) -> str:
    w = "weight" if weighted else "1.0::DOUBLE"
    return f"""WITH {graph}, u AS MATERIALIZED (SELECT src, dst, {w} AS w FROM e), {_DEG.replace("d AS MATERIALIZED", "dg AS MATERIALIZED")},
 dd AS (SELECT idx, {"weighted_degree" if weighted else "degree::DOUBLE"} AS d FROM dg),
 t AS (SELECT a.src AS i, a.dst AS j, b.dst AS k, a.w * b.w * c.w AS p FROM u a JOIN u b ON b.src = a.dst JOIN u c ON c.src = a.src AND c.dst = b.dst),
 ti AS (SELECT idx, sum(p) AS t FROM (SELECT i AS idx, p FROM t UNION ALL SELECT j, p FROM t UNION ALL SELECT k, p FROM t) GROUP BY idx),
 m AS (SELECT dd.idx, trunc(coalesce(t, 0))::BIGINT AS triangles, round(greatest(0.0, least(1.0, coalesce(t, 0) / CASE WHEN d * (d - 1) / 2 = 0 THEN 1 ELSE d * (d - 1) / 2 END)), 6) + 0.0 AS cc, greatest(0.0, least(1.0, coalesce(t, 0) / CASE WHEN d * (d - 1) / 2 = 0 THEN 1 ELSE d * (d - 1) / 2 END)) AS raw, trunc(d)::INTEGER AS degree FROM dd LEFT JOIN ti ON ti.idx = dd.idx)
"""


def _part(k: int, hours: int) -> str:
    return f"(SELECT event_type AS algorithm, round(avg(value), 4) AS seconds FROM events WHERE coalesce(hour(ts) // {hours}, 0) = {k} GROUP BY 1)"


_SPEED = f"""WITH j AS (SELECT coalesce(a.algorithm, b.algorithm) AS algorithm, a.seconds AS single_time_s, b.seconds AS parallel_time_s FROM {_part(0, 12)} a FULL JOIN {_part(1, 12)} b ON a.algorithm = b.algorithm),
 k AS (SELECT *, round_even(single_time_s / nullif(parallel_time_s, 0), 3) AS speedup_x FROM j),
 rep AS (SELECT *, round_even(speedup_x / 8 * 100, 1) AS efficiency_pct FROM k)
"""
_THREE = f"""WITH j AS (SELECT coalesce(g.algorithm, a.algorithm, b.algorithm) AS algorithm, g.seconds AS gpu_time_s, a.seconds AS single_time_s, b.seconds AS parallel_time_s FROM {_part(2, 8)} g FULL JOIN {_part(0, 8)} a ON a.algorithm = g.algorithm FULL JOIN {_part(1, 8)} b ON b.algorithm = coalesce(g.algorithm, a.algorithm)),
 t AS (SELECT *, round_even(single_time_s / nullif(gpu_time_s, 0), 2) AS gpu_vs_single, round_even(parallel_time_s / nullif(gpu_time_s, 0), 2) AS gpu_vs_parallel FROM j)
"""


def _gcn(inner: int = 64, hidden: int = 64, out: int = 32) -> str:
    """Two layers over rows (idx, j, v); the seeded weights come in as VALUES."""
    rng = np.random.default_rng(42)
    rng.standard_normal((1, 16))  # the random row of the default features is drawn first
    w1 = rng.standard_normal((inner, hidden)) * np.sqrt(2.0 / (inner + hidden))
    w2 = rng.standard_normal((hidden, out)) * np.sqrt(2.0 / (hidden + out))
    values = lambda w: ", ".join(f"({i},{j},{float(x)!r}::DOUBLE)" for (i, j), x in np.ndenumerate(w))
    moved = lambda h: f"SELECT a.dst AS idx, h.j, sum(a.weight * h.v) AS v FROM adj a JOIN {h} h ON h.idx = a.src GROUP BY 1, 2"
    times = lambda h, w: f"SELECT h.idx, w.k AS j, sum(h.v * w.x) AS v FROM {h} h JOIN {w} w ON w.j = h.j GROUP BY 1, 2"
    return f"""WITH {_EMBG}, {_ADJ}, w1(j, k, x) AS (VALUES {values(w1)}), w2(j, k, x) AS (VALUES {values(w2)}),
 h0 AS MATERIALIZED (SELECT vec_id AS idx, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
 m1 AS MATERIALIZED ({moved("h0")}), p1 AS MATERIALIZED ({times("m1", "w1")}), h1 AS (SELECT idx, j, greatest(v, 0) AS v FROM p1),
 m2 AS MATERIALIZED ({moved("h1")}), h2 AS MATERIALIZED ({times("m2", "w2")}),
 u AS (SELECT idx, j, v / CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY idx)) = 0 THEN 1 ELSE sqrt(sum(v * v) OVER (PARTITION BY idx)) END AS v FROM h2)
 SELECT idx, {", ".join(f"round(max(CASE WHEN j = {i} THEN v END), 6) + 0.0 AS dim_{i}" for i in range(out))} FROM u GROUP BY idx"""


_ADJ = """a0 AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM s UNION ALL SELECT idx, idx, 1.0 FROM v) GROUP BY 1, 2),
 dr AS (SELECT src, sum(weight) AS d FROM a0 GROUP BY src),
 adj AS MATERIALIZED (SELECT a0.src, a0.dst, a0.weight * (1 / sqrt(x.d)) * (1 / sqrt(y.d)) AS weight FROM a0 JOIN dr x ON x.src = a0.src JOIN dr y ON y.src = a0.dst)"""
_SEEDLIST = ", ".join(map(str, SEEDS))

SQL = {
    "lib_sizes": f"WITH {_GRID} SELECT sample, round(lib_size, 6) AS lib_size FROM lib",
    "cpm": f"WITH {_GRID} SELECT gene, sample, round(cpm, 4) AS cpm FROM c",
    "cpm_filter": f"WITH {_GRID}, k AS (SELECT gene, count(*) FILTER (cpm >= 5000) AS n_expressed FROM c GROUP BY gene) SELECT gene, n_expressed FROM k WHERE n_expressed >= floor(0.2 * (SELECT count(DISTINCT sample) FROM grid))",
    "log2_cpm": f"WITH {_GRID} SELECT gene, sample, round(value, 6) AS value FROM x",
    "zscore": f"WITH {_GRID}, {_Z} SELECT gene, sample, round(z, 6) + 0.0 AS z FROM z",
    "coexpr_edges": f"WITH {_GRIDR} SELECT src, dst, round(weight, 6) AS weight FROM r WHERE weight >= 0.7",
    "coexpr_edges_emb": f"WITH {_EMBR} SELECT src, dst, round(weight, 6) AS weight FROM r WHERE weight >= {EMB}",
    "coexpr_edges_blocks": f"WITH {_EMBR} SELECT src, dst, round(weight, 6) AS weight FROM r WHERE weight >= {EMB}",
    "coexpr_edges_gaps": f"""WITH t AS (SELECT * EXCLUDE (rn) FROM (SELECT upper(trim(gene_id, ' ' || chr(9) || chr(10) || chr(13))) AS gene, COLUMNS('dim_.*'), row_number() OVER (PARTITION BY upper(trim(gene_id, ' ' || chr(9) || chr(10) || chr(13))) ORDER BY computed_at DESC, loaded_at DESC) AS rn FROM gpu_gnn_embeddings WHERE gene_id IS NOT NULL) WHERE rn = 1),
 x AS MATERIALIZED (SELECT gene, sample, value::DOUBLE AS value FROM (UNPIVOT t ON COLUMNS(* EXCLUDE gene) INTO NAME sample VALUE value) WHERE NOT isnan(value::DOUBLE)), {_Z}, {_PAIR} SELECT src, dst, round(weight, 6) AS weight FROM r WHERE weight >= 0.9""",
    "max_genes_prefix": "SELECT row_idx, l_orderkey, l_linenumber FROM (SELECT row_number() OVER () - 1 AS row_idx, l_orderkey, l_linenumber FROM lineitem) WHERE row_idx < 1000",
    "max_genes_half": "SELECT row_idx, l_orderkey, l_linenumber FROM (SELECT row_number() OVER () - 1 AS row_idx, l_orderkey, l_linenumber FROM lineitem) WHERE row_idx < (SELECT count(*) // 2 FROM lineitem)",
    "wide_to_long": "WITH u AS (UNPIVOT (SELECT * EXCLUDE (computed_at, loaded_at) FROM gpu_gnn_embeddings) ON COLUMNS(* EXCLUDE gene_id) INTO NAME sample VALUE value) SELECT sample, count(*) AS n, count(DISTINCT gene_id) AS genes FROM u WHERE NOT isnan(value::DOUBLE) GROUP BY sample",
    "n_genes_prefix": f"WITH {_G} SELECT src, dst, round(weight, 6) AS weight FROM e WHERE src < 1500 AND dst < 1500",
    "n_genes_half": f"WITH {_G}, axis AS (SELECT gene_idx, row_number() OVER (ORDER BY gene_idx) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT gene_idx FROM genes_filtered WHERE gene_idx IS NOT NULL)), mid AS (SELECT gene_idx AS bound FROM axis WHERE pos = n // 2) SELECT src, dst, round(weight, 6) AS weight FROM e JOIN mid ON src < bound AND dst < bound",
    "symmetric_edges": f"WITH {_G} SELECT src, dst, round(weight, 6) AS weight FROM s",
    "graph_stats": f"WITH {_G}, {_DEG} SELECT count(*) AS nodes, sum(degree)::BIGINT AS nnz, (sum(degree) // 2)::BIGINT AS unique_edges, round(sum(degree) / (count(*) * count(*)), 9) AS density, round(avg(weighted_degree), 6) AS avg_degree, round(max(weighted_degree), 6) AS max_degree, count(*) FILTER (weighted_degree = 0) AS isolated FROM d",
    "weighted_degree": f"WITH {_G}, {_DEG} SELECT idx, degree, round(weighted_degree, 6) AS weighted_degree FROM d",
    "isolated_nodes": f"WITH {_G}, {_DEG} SELECT idx FROM d WHERE degree = 0",
    "gene_id_join": f"WITH {_G}, {_DEG} SELECT coalesce(g.gene_id, d.idx::VARCHAR) AS gene_id, round(weighted_degree, 6) AS weighted_degree FROM d LEFT JOIN (SELECT DISTINCT gene_idx, gene_id FROM genes_filtered) g ON g.gene_idx = d.idx",
    "topn_subgraph": f"WITH {_G}, {_DEG}, t AS (SELECT idx FROM d ORDER BY weighted_degree DESC, idx LIMIT 100), pos AS (SELECT idx, (row_number() OVER (ORDER BY idx) - 1)::INTEGER AS pos FROM t) SELECT src, dst, a.pos AS row, b.pos AS col, round(weight, 6) AS weight FROM s JOIN pos a ON a.idx = src JOIN pos b ON b.idx = dst",
    "spmv": f"WITH {_G} SELECT dst AS idx, round(sum(weight * (src % 7 + 1.0::DOUBLE)), 6) AS y FROM s GROUP BY dst",
    "spgemm": f"WITH {_EMBG} SELECT a.src AS row, b.dst AS col, round(sum(a.weight * b.weight), 6) AS val FROM s a JOIN s b ON b.src = a.dst GROUP BY 1, 2",
    "col_stochastic": f"WITH {_EMBG} SELECT src AS row, dst AS col, round(weight / sum(weight) OVER (PARTITION BY dst), 6) AS val FROM s",
    "row_stochastic": f"WITH {_EMBG} SELECT src AS row, dst AS col, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS val FROM s",
    "vector_norms": f"WITH {_G}, {_DEG} SELECT round(sum(abs(weighted_degree)), 4) AS l1, round(sqrt(sum(weighted_degree * weighted_degree)), 4) AS l2, round(max(abs(weighted_degree)), 6) AS max FROM d",
    "bfs_single": _BFS.format(g=_G, seeds="0") + "SELECT idx, dist FROM f",
    "bfs_multi": _BFS.format(g=_G, seeds=_SEEDLIST) + "SELECT source, idx, dist FROM f",
    "bfs_pivot": _BFS.format(g=_G, seeds=_SEEDLIST) + "SELECT idx, " + ", ".join(f"max(CASE WHEN source = {k} THEN dist END) AS dist_from_{k}" for k in SEEDS) + " FROM f GROUP BY idx",
    "reachable": _BFS.format(g=_G, seeds=_SEEDLIST) + "SELECT source, count(*) FILTER (dist >= 0) AS n FROM f GROUP BY source",
    "pagerank_k": _pagerank(STEPS, False),
    "pagerank_compat_k": _pagerank(5, True),
    "rwr_k": _rwr(STEPS) + f" SELECT idx, round(x, 9) AS rwr FROM x{STEPS}",
    "rwr_ensemble_k": _rwr(5) + " SELECT idx, round(x, 9) AS rwr FROM x5 WHERE x > 0",
    "hits_k": _hits(5),
    "cond_entropy_pairs": _MCE + "SELECT regulator, target, round(h, 6) + 0.0 AS h FROM h",
    "mce": _MCES + " SELECT gene, mce_score FROM m",
    "top_regulator": _MCES + " SELECT gene, mce_score FROM m ORDER BY mce_score, gene LIMIT 1",
    "cond_entropy_pairs_all": _MCE_ALL + "SELECT regulator, target, round(h, 6) + 0.0 AS h FROM h",
    "mce_all": _MCES_ALL + " SELECT gene, mce_score FROM m",
    "top_regulator_all": _MCES_ALL + " SELECT gene, mce_score FROM m ORDER BY mce_score, gene LIMIT 1",
    "motif_weighted": _motif(_EMBG, True) + "SELECT idx, triangles, cc AS clustering_coeff, degree FROM m",
    "motif_unweighted": _motif(_G, False) + "SELECT idx, triangles, cc AS clustering_coeff, degree FROM m",
    "motif_totals": _motif(_G, False) + "SELECT (sum(triangles) // 3)::BIGINT AS total_triangles, round(avg(raw), 6) AS avg_clustering FROM m",
    "modularity": f"WITH {_G}, k AS (SELECT src % 5 AS c, sum(weight) AS k, sum(CASE WHEN src % 5 = dst % 5 THEN weight ELSE 0 END) AS i FROM s GROUP BY 1) SELECT (SELECT count(DISTINCT idx % 5) FROM v) AS communities, round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) + 0.0 AS modularity FROM k",
    "mcl_step": _mcl(1) + " SELECT row, col, round(val, 6) AS val FROM m1",
    "mcl_k": _mcl(3) + " SELECT row, col, round(val, 6) AS val FROM m3",
    "mcl_clusters": _mcl(3) + ", att AS (SELECT row FROM m3 WHERE row = col AND val > 0.01), b AS (SELECT col AS idx, m3.row, row_number() OVER (PARTITION BY col ORDER BY val DESC, m3.row) AS rn FROM m3 JOIN att ON att.row = m3.row) SELECT v.idx, coalesce(b.row, (SELECT min(row) FROM att), v.idx) AS community FROM v LEFT JOIN b ON b.idx = v.idx AND b.rn = 1",
    "gcn_norm_adj": f"WITH {_G}, {_ADJ} SELECT src, dst, round(weight, 8) AS weight FROM adj",
    "gcn_propagate": f"WITH {_G}, {_ADJ} SELECT dst AS idx, round(sum(weight * sin(src)), 8) + 0.0 AS y FROM adj GROUP BY dst",
    "timing_speedup": _SPEED + "SELECT * FROM rep",
    "three_way": _THREE + "SELECT * FROM t",
    "timing_own": f"SELECT algorithm, seconds AS parallel_time_s FROM {_part(0, 24)}",
    "timing_text": _THREE + "SELECT algorithm, " + ", ".join(f"coalesce(printf('%.4f', {c}), 'N/A') AS {c}" for c in ("gpu_time_s", "single_time_s", "parallel_time_s")) + ", " + ", ".join(f"coalesce(printf('%.2fx', {c}), 'N/A') AS {c}" for c in ("gpu_vs_single", "gpu_vs_parallel")) + " FROM t",
    "inspect": "SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE lineitem))::INTEGER AS columns FROM lineitem",
    "graph_sink": f"WITH {_G} SELECT src, dst, round(weight, 6) AS weight FROM s",
    "scores_sink": f"WITH {_G}, {_DEG} SELECT coalesce(g.gene_id, d.idx::VARCHAR) AS gene_id, round(weighted_degree, 6) AS score FROM d LEFT JOIN (SELECT DISTINCT gene_idx, gene_id FROM genes_filtered) g ON g.gene_idx = d.idx",
    "partition_sink": "SELECT DISTINCT gene_id, (gene_idx % 5)::INTEGER AS community FROM genes_filtered",
    "modularity_stored": f"""WITH {_G}, c AS (SELECT gene, community FROM (SELECT upper(trim(gene_id, ' ' || chr(9) || chr(10) || chr(13))) AS gene, community, row_number() OVER (PARTITION BY upper(trim(gene_id, ' ' || chr(9) || chr(10) || chr(13))) ORDER BY computed_at DESC, loaded_at DESC, community DESC NULLS LAST) AS rn FROM louvain_communities WHERE gene_id IS NOT NULL) WHERE rn = 1),
 m AS (SELECT gene_idx AS idx, max(community) AS c FROM genes_filtered JOIN c ON c.gene = upper(trim(gene_id)) GROUP BY 1),
 q AS MATERIALIZED (SELECT v.idx, coalesce(m.c, -1 - v.idx) AS c FROM v LEFT JOIN m ON m.idx = v.idx),
 k AS (SELECT a.c, sum(weight) AS k, sum(CASE WHEN a.c = b.c THEN weight ELSE 0 END) AS i FROM s JOIN q a ON a.idx = src JOIN q b ON b.idx = dst GROUP BY 1)
 SELECT (SELECT count(DISTINCT c) FROM q) AS communities, round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) + 0.0 AS modularity FROM k""",
    "gcn_embed": _gcn(),
    "timing_totals": _SPEED + "SELECT round(sum(CASE WHEN parallel_time_s IS NOT NULL THEN single_time_s END), 4) AS total_single, round(sum(CASE WHEN single_time_s IS NOT NULL THEN parallel_time_s END), 4) AS total_parallel, round(avg(speedup_x), 4) AS mean_speedup, round(avg(efficiency_pct), 4) AS mean_efficiency, round(sum(CASE WHEN parallel_time_s IS NOT NULL THEN single_time_s END) / sum(CASE WHEN single_time_s IS NOT NULL THEN parallel_time_s END), 4) AS overall_speedup FROM rep",
}
