"""Queries of the network operators on the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions.clean import tidy_key, usable
from netspark.operators import community, correlate, entropy, expr, gcn, graph, linalg, mcl, motif, rank, report, traverse
from netspark.operators.standing import standing_rows
from netspark.sources import counts, sinks
from netspark.sources.sinks import with_gene_ids
from netspark.sources.tables import table
from netspark.workspace import Workspace

SEEDS = (0, 3, 8)
STEPS = 10
EMB = 0.3
MONTHS = 10_000


# inputs ---------------------------------------------------------------------


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, sample, value): quantity per supplier and month, 0 where there is none."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gene"), F.date_format("l_shipdate", "yyyy-MM").alias("sample")).agg(F.sum("l_quantity").alias("v"))
    q = Workspace(spark, "grid").save(q, "q")
    months = [r[0] for r in q.select("sample").distinct().limit(MONTHS + 1).collect()]  # a calendar, not data
    if len(months) > MONTHS:
        raise ValueError(f"more than {MONTHS} months")
    grid = q.select("gene").distinct().select("gene", F.explode(F.array(*[F.lit(m) for m in months])).alias("sample"))
    return grid.join(q, ["gene", "sample"], "left").select("gene", "sample", F.coalesce("v", F.lit(0.0)).alias("value"))


def _log2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    long = Workspace(spark, "log2").save(supplier_months(spark, sf_dir), "long")
    return expr.log2_cpm(expr.cpm(long)), long.select("sample").distinct().count()


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.vectors_to_long(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _emb_edges(spark: SparkSession, sf_dir: str, blocks: bool = False) -> DataFrame:
    z = expr.zscore(_embedded(spark, sf_dir))
    return correlate.edges_by_blocks(z, 64, EMB) if blocks else correlate.coexpr_edges(z, 64, EMB)


def gene_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The symmetric graph of ``edge_list`` over all genes."""
    ws = Workspace(spark, "graph")
    e = ws.save(graph.symmetrise(graph.clean_edges(table(spark, sf_dir, "edge_list"))), "edges")
    v = ws.save(graph.vertices_of(e, table(spark, sf_dir, "genes_filtered").select(F.col("gene_idx").alias("idx"))), "vertices")
    return graph.Graph(v, e, symmetric=True)


def forward_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The same edges from the smaller to the greater index only."""
    g = gene_graph(spark, sf_dir)
    return graph.Graph(g.vertices, g.edges.where("src < dst"))


def emb_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    ws = Workspace(spark, "graph")
    e = ws.save(graph.symmetrise(_emb_edges(spark, sf_dir)), "edges")
    return graph.Graph(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx")).distinct(), e)


def _r(c: str, digits: int = 6, name: str | None = None):
    return (F.round(c, digits) + 0.0).alias(name or c)


# matrix queries -------------------------------------------------------------


def lib_sizes(spark, d):
    return expr.library_sizes(supplier_months(spark, d)).select("sample", _r("lib_size"))


def cpm(spark, d):
    return expr.cpm(Workspace(spark, "cpm").save(supplier_months(spark, d), "long")).select("gene", "sample", _r("cpm", 4))


def cpm_filter(spark, d):
    long = Workspace(spark, "cpm").save(supplier_months(spark, d), "long")
    return expr.kept_genes(expr.cpm(long), 5000.0, 0.2)


def log2_cpm(spark, d):
    return _log2(spark, d)[0].select("gene", "sample", _r("value"))


def zscore(spark, d):
    return expr.zscore(_log2(spark, d)[0]).select("gene", "sample", _r("z"))


def coexpr_edges(spark, d, threshold: float = 0.7):
    x, s = _log2(spark, d)
    return correlate.coexpr_edges(expr.zscore(x), s, threshold).select("src", "dst", _r("weight"))


def coexpr_edges_emb(spark, d):
    return _emb_edges(spark, d).select("src", "dst", _r("weight"))


def coexpr_edges_blocks(spark, d):
    return _emb_edges(spark, d, True).select("src", "dst", _r("weight"))


def coexpr_edges_gaps(spark, d):
    """Edges of genes whose vectors lack elements, by blocks: sums go over common samples."""
    dims = [f"dim_{i}" for i in range(32)]
    t = standing_rows(table(spark, d, "gpu_gnn_embeddings"), tidy_key("gene_id"), dims, name="gene_id")
    z = expr.zscore(counts.to_long(t, "gene_id").where(usable("value")))
    return correlate.edges_by_blocks(z, 32, 0.9).select("src", "dst", _r("weight"))


def max_genes_prefix(spark, d):
    """Rows of the first 1,000 lines of the file: a prefix in file order is the operator."""
    return counts.row_prefix(spark, f"{d}/lineitem.parquet", 1000).select("row_idx", "l_orderkey", "l_linenumber")


def max_genes_half(spark, d):
    """Rows of the first half of the file's lines."""
    path = f"{d}/lineitem.parquet"
    return counts.row_prefix(spark, path, spark.read.parquet(path).count() // 2).select("row_idx", "l_orderkey", "l_linenumber")


def wide_to_long(spark, d):
    t = table(spark, d, "gpu_gnn_embeddings").drop("computed_at", "loaded_at")
    return counts.to_long(t).where("value is not null and not isnan(value)").groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gene").alias("genes"))


def n_genes_prefix(spark, d):
    """Edges among the genes of index below 1,500."""
    e = graph.clean_edges(table(spark, d, "edge_list"))
    return e.where("src < 1500 and dst < 1500").select("src", "dst", _r("weight"))


def n_genes_half(spark, d):
    """Edges among the first half of the gene axis: the indexes below that of the middle gene."""
    genes = table(spark, d, "genes_filtered").where("gene_idx is not null").select("gene_idx").distinct()
    genes = Workspace(spark, "axis").save(genes, "genes")
    n = genes.count()
    bound = F.lit(counts.nth_smallest(genes, "gene_idx", n // 2) if n else None)
    e = graph.clean_edges(table(spark, d, "edge_list"))
    return e.where((F.col("src") < bound) & (F.col("dst") < bound)).select("src", "dst", _r("weight"))


# graph queries --------------------------------------------------------------


def symmetric_edges(spark, d):
    return gene_graph(spark, d).edges.select("src", "dst", _r("weight"))


def graph_stats(spark, d):
    s = graph.graph_stats(gene_graph(spark, d))
    return s.select("nodes", "nnz", "unique_edges", _r("density", 9), _r("avg_degree"), _r("max_degree"), "isolated")


def weighted_degree(spark, d):
    return graph.degrees(gene_graph(spark, d)).select("idx", "degree", _r("weighted_degree"))


def isolated_nodes(spark, d):
    return graph.degrees(gene_graph(spark, d)).where("degree = 0").select("idx")


def gene_id_join(spark, d):
    g = gene_graph(spark, d)
    genes = table(spark, d, "genes_filtered").select(F.col("gene_idx").alias("idx"), "gene_id").distinct()
    return with_gene_ids(graph.degrees(g), genes).select("gene_id", _r("weighted_degree"))


def topn_subgraph(spark, d):
    sub, pos = graph.top_subgraph(gene_graph(spark, d), 100)
    a, b = pos.select(F.col("idx").alias("src"), F.col("pos").alias("row")), pos.select(F.col("idx").alias("dst"), F.col("pos").alias("col"))
    return sub.edges.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").select("src", "dst", "row", "col", _r("weight"))


def spmv(spark, d):
    g = gene_graph(spark, d)
    return linalg.spmv(g.edges, g.vertices.select("idx", (F.pmod("idx", F.lit(7)) + 1.0).alias("x")), g.hot).select("idx", _r("y"))


def _emb_triples(spark, d) -> DataFrame:
    return emb_graph(spark, d).edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("val"))


def spgemm(spark, d):
    m = _emb_triples(spark, d)
    return linalg.spgemm(m, m).select("row", "col", _r("val"))


def col_stochastic(spark, d):
    return linalg.normalise(_emb_triples(spark, d), "col").select("row", "col", _r("val"))


def row_stochastic(spark, d):
    return linalg.normalise(_emb_triples(spark, d), "row").select("row", "col", _r("val"))


def vector_norms(spark, d):
    x = graph.degrees(gene_graph(spark, d)).select(F.col("weighted_degree").alias("x"))
    return linalg.norms(x).select(_r("l1", 4), _r("l2", 4), _r("max"))


def bfs_single(spark, d):
    return traverse.bfs(gene_graph(spark, d), [0]).select("idx", "dist")


def bfs_multi(spark, d):
    return traverse.bfs(gene_graph(spark, d), list(SEEDS))


def bfs_pivot(spark, d):
    return traverse.bfs_wide(bfs_multi(spark, d), list(SEEDS))


def reachable(spark, d):
    return traverse.reachable(bfs_multi(spark, d))


def pagerank_k(spark, d):
    return rank.pagerank(gene_graph(spark, d), tol=None, max_iter=STEPS).select("idx", _r("x", 9, "pagerank"))


def pagerank_compat_k(spark, d):
    """Unit weights, where vertices of degree 1 count as dangling."""
    g = gene_graph(spark, d)
    unit = graph.Graph(g.vertices, g.edges.withColumn("weight", F.lit(1.0)))
    return rank.pagerank(unit, tol=None, max_iter=5, compat=True).select("idx", _r("x", 9, "pagerank"))


def rwr_k(spark, d):
    return rank.rwr(gene_graph(spark, d), list(SEEDS), tol=None, max_iter=STEPS).select("idx", _r("x", 9, "rwr"))


def rwr_ensemble_k(spark, d):
    x = rank.rwr_each(gene_graph(spark, d), list(SEEDS), steps=5)
    return x.groupBy("idx").agg((F.sum("x") / len(SEEDS)).alias("x")).select("idx", _r("x", 9, "rwr"))


def hits_k(spark, d):
    return rank.hits(forward_graph(spark, d), tol=None, max_iter=5).select("idx", _r("hub", 8), _r("authority", 8))


def _entropy_input(spark, d) -> tuple[DataFrame, DataFrame]:
    x = Workspace(spark, "mce").save(_log2(spark, d)[0], "x")
    return x, x.select("gene").distinct().orderBy("gene").limit(50)


def cond_entropy_pairs(spark, d):
    return entropy.entropy_by_blocks(*_entropy_input(spark, d)).select("regulator", "target", _r("h"))


def mce(spark, d):
    return entropy.mce(*_entropy_input(spark, d)).select("gene", _r("mce_score"))


def top_regulator(spark, d):
    return mce(spark, d).orderBy("mce_score", "gene").limit(1)


def cond_entropy_pairs_all(spark, d):
    """Every gene as a regulator, where ``cond_entropy_pairs`` has the first 50."""
    return entropy.entropy_by_blocks(_entropy_input(spark, d)[0], digits=6)


def mce_all(spark, d):
    return entropy.mce_all(_entropy_input(spark, d)[0]).select("gene", _r("mce_score"))


def top_regulator_all(spark, d):
    return mce_all(spark, d).orderBy("mce_score", "gene").limit(1)


def motif_weighted(spark, d):
    return motif.motifs(emb_graph(spark, d), True).select("idx", "triangles", _r("clustering_coeff"), "degree")


def motif_unweighted(spark, d):
    return motif.motifs(gene_graph(spark, d), False).select("idx", "triangles", _r("clustering_coeff"), "degree")


def motif_totals(spark, d):
    return motif.motif_totals(motif.motifs(gene_graph(spark, d), False)).select("total_triangles", _r("avg_clustering"))


def modularity(spark, d):
    g = gene_graph(spark, d)
    return community.modularity(g, g.vertices.select("idx", F.pmod("idx", F.lit(5)).alias("community"))).select("communities", _r("modularity"))


def louvain(spark, d):
    return community.louvain(gene_graph(spark, d))


def louvain_quality(spark, d):
    g = gene_graph(spark, d)
    return community.modularity(g, community.louvain(g)).select("communities", _r("modularity"))


def mcl_step(spark, d):
    return mcl.mcl_step(mcl.mcl_start(emb_graph(spark, d))).select("row", "col", _r("val"))


def _mcl3(spark, d):
    g = emb_graph(spark, d)
    return g, mcl.mcl(g, max_iter=3, tol=None)


def mcl_k(spark, d):
    return _mcl3(spark, d)[1].select("row", "col", _r("val"))


def mcl_clusters(spark, d):
    g, m = _mcl3(spark, d)
    return mcl.mcl_clusters(m, g.vertices)


def gcn_norm_adj(spark, d):
    return gcn.normalised_adjacency(gene_graph(spark, d)).select("src", "dst", _r("weight", 8))


def gcn_propagate(spark, d):
    g = gene_graph(spark, d)
    x = g.vertices.select("idx", F.sin(F.col("idx").cast("double")).alias("x"))
    return linalg.spmv(gcn.normalised_adjacency(g), x, g.hot).select("idx", _r("y", 8))


def gcn_embed(spark, d):
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    e = gcn.wide(gcn.gcn(emb_graph(spark, d), h))
    return e.select("idx", *[_r(f"dim_{i}") for i in range(32)])


def _timings(spark, d, part: int, hours: int) -> DataFrame:
    """Mean value, as seconds, of every event type in one part of the day; the parts cover all events."""
    e = table(spark, d, "events").where(F.coalesce(F.floor(F.hour("ts") / hours), F.lit(0)) == part)
    return e.groupBy(F.col("event_type").alias("algorithm")).agg(F.round(F.avg("value"), 4).alias("seconds"))


def timing_speedup(spark, d):
    return report.speedup_report(_timings(spark, d, 0, 12), _timings(spark, d, 1, 12))


def three_way(spark, d):
    return report.three_way_report(_timings(spark, d, 2, 8), _timings(spark, d, 0, 8), _timings(spark, d, 1, 8))


def timing_totals(spark, d):
    return report.report_totals(timing_speedup(spark, d)).select(*[_r(c, 4) for c in ("total_single", "total_parallel", "mean_speedup", "mean_efficiency", "overall_speedup")])


def timing_own(spark, d):
    """The report without a baseline."""
    return report.own_report(_timings(spark, d, 0, 24))


def timing_text(spark, d):
    """The three-way report as text."""
    return report.printed(three_way(spark, d))


# operators by tolerance, sinks, stored results --------------------------------


def pagerank(spark, d):
    return rank.pagerank(gene_graph(spark, d)).select("idx", _r("x", 9, "pagerank"))


def rwr(spark, d):
    return rank.rwr(gene_graph(spark, d), list(SEEDS)).select("idx", _r("x", 9, "rwr"))


def hits(spark, d):
    return rank.hits(forward_graph(spark, d)).select("idx", _r("hub", 8), _r("authority", 8))


def bfs_random(spark, d):
    """From three vertices drawn by seed."""
    g = gene_graph(spark, d)
    return traverse.bfs(g, traverse.source_vertices(g.vertices, 3))


def inspect(spark, d):
    return counts.inspect_parquet(spark, f"{d}/lineitem.parquet").select("rows", "columns")


def graph_sink(spark, d):
    """The symmetric graph as written, bucketed by source, and read back."""
    ws = Workspace(spark, "sink")
    name = f"netspark_{uuid.uuid4().hex}"
    sinks.save_graph(graph.clean_edges(table(spark, d, "edge_list")), ws.at("graph"), name, 16)
    ws.own("graph", name)
    return spark.table(name).select("src", "dst", _r("weight"))


def scores_sink(spark, d):
    ws = Workspace(spark, "sink")
    g = gene_graph(spark, d)
    genes = table(spark, d, "genes_filtered").select(F.col("gene_idx").alias("idx"), "gene_id").distinct()
    sinks.save_scores(graph.degrees(g).select("idx", _r("weighted_degree", 6, "score")), genes, ws.at("scores"), "score")
    return spark.read.csv(ws.at("scores"), header=True).select("gene_id", F.col("score").cast("double").alias("score"))


def partition_sink(spark, d):
    ws = Workspace(spark, "sink")
    genes = table(spark, d, "genes_filtered").select(F.col("gene_idx").alias("idx"), "gene_id").distinct()
    sinks.save_partition(genes.select("idx", F.pmod("idx", F.lit(5)).alias("community")), genes, ws.at("parts"))
    return spark.read.csv(ws.at("parts"), header=True).select("gene_id", F.col("community").cast("int").alias("community"))


def modularity_stored(spark, d):
    """Modularity of the stored partition; genes without a community are alone."""
    g = gene_graph(spark, d)
    name = table(spark, d, "genes_filtered").select(F.col("gene_idx").alias("idx"), tidy_key("gene_id").alias("gene")).distinct()
    part = standing_rows(table(spark, d, "louvain_communities"), tidy_key("gene_id"), ["community"], name="gene")
    named = name.join(part, "gene").groupBy("idx").agg(F.max("community").alias("c"))
    parts = g.vertices.join(named, "idx", "left").select("idx", F.coalesce("c", -1 - F.col("idx")).alias("community"))
    return community.modularity(g, Workspace(spark, "parts").save(parts, "parts")).select("communities", _r("modularity"))


_NAMES = """lib_sizes cpm cpm_filter log2_cpm zscore coexpr_edges coexpr_edges_emb coexpr_edges_blocks coexpr_edges_gaps max_genes_prefix max_genes_half wide_to_long
n_genes_prefix n_genes_half symmetric_edges graph_stats weighted_degree isolated_nodes gene_id_join topn_subgraph spmv spgemm col_stochastic
row_stochastic vector_norms bfs_single bfs_multi bfs_pivot reachable pagerank_k pagerank_compat_k rwr_k rwr_ensemble_k hits_k
cond_entropy_pairs mce top_regulator cond_entropy_pairs_all mce_all top_regulator_all motif_weighted motif_unweighted motif_totals modularity louvain louvain_quality mcl_step
mcl_k mcl_clusters gcn_norm_adj gcn_propagate gcn_embed timing_speedup three_way timing_totals
timing_own timing_text pagerank rwr hits bfs_random inspect graph_sink scores_sink partition_sink modularity_stored""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
