"""python -m netspark.cli: from count tables to a graph, and from a graph to results.

    graph --input COUNTS.parquet --outdir OUT [--max-genes N] [--cpm-threshold X] [--min-samples-frac X] [--corr-threshold X] [--resume]
    run --graph OUT --outdir RESULTS [--algo NAME|all|m21|m22|m23] [--single-timing CSV] [--parallel-timing CSV] ...
    doctor
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.doctor import doctor
from netspark.operators import community, correlate, entropy, expr, gcn, graph, mcl, motif, rank, report, traverse
from netspark.operators.lookup import SMALL_BYTES
from netspark.session import get_session
from netspark.sources import counts, sinks
from netspark.workspace import Workspace, clean

#: groups of algorithms by name (fixed values)
GROUPS = {"m21": ["bfs", "pagerank", "mce"], "m22": ["rwr", "hits", "louvain"], "m23": ["mcl", "motif", "gnn"]}
ALGOS = [a for g in GROUPS.values() for a in g]


def chosen(name: str) -> list[str]:
    return ALGOS if name == "all" else GROUPS.get(name, [name])


def build_graph(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Counts to edges; every stage is a table that ``--resume`` takes up again.

    Genes go by their row number until the filter, then by a dense index in that order.
    """
    at = lambda s: f"{a.outdir}/{s}"
    made = f"{a.input} {a.max_genes} {a.cpm_threshold} {a.min_samples_frac} {a.corr_threshold}"
    stage = lambda s, make: sinks.stage(spark, at(s), make, a.resume, made)
    raw = counts.row_prefix(spark, a.input, a.max_genes)
    long = stage("counts_long", lambda: counts.to_long(raw, index="row_idx"))
    libs = stage("lib_sizes", lambda: expr.library_sizes(long))
    samples = libs.count()
    cpm = expr.cpm(long, libs)

    def filtered() -> DataFrame:
        kept = expr.kept_genes(cpm, a.cpm_threshold, a.min_samples_frac, samples).join(counts.gene_names(raw, "row_idx"), "gene")
        dense = F.row_number().over(Window.orderBy("gene")) - 1  # one row a gene, of --max-genes at most
        return kept.select(dense.cast("int").alias("gene_idx"), "gene_id", "n_expressed", F.col("gene").alias("row_idx"))

    genes = stage("genes_filtered", filtered)
    names = genes.select(F.col("row_idx").alias("gene"), "gene_idx")
    log2 = stage("expr_log2", lambda: expr.log2_cpm(cpm, names).join(F.broadcast(names) if genes.count() * 64 <= SMALL_BYTES else names, "gene").select(F.col("gene_idx").alias("gene"), "sample", "value"))
    edges = stage("edges", lambda: correlate.coexpr_edges(expr.zscore(log2), samples, a.corr_threshold))
    sinks.save_edges(edges, at("edge_list_csv"), "csv")
    sinks.save_graph(edges, at("adjacency"))
    g = graph.Graph(genes.select(F.col("gene_idx").alias("idx")), spark.read.parquet(at("adjacency")), symmetric=True)
    graph.graph_stats(g).write.mode("overwrite").csv(at("graph_stats"), header=True)
    return edges


def run_algos(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Runs the chosen algorithms, writes each result, the seconds and the report."""
    ws = Workspace(spark, "run")
    found = (lambda name, given: given or (f"{a.graph}/{name}" if a.graph else None))
    edges, genes, expression = found("edges", a.edges), found("genes_filtered", a.genes), found("expr_log2", a.expr)
    if not edges or not genes:
        raise SystemExit("give --graph, or --edges and --genes")
    e = ws.save(graph.symmetrise(spark.read.parquet(edges).where("src < dst")), "edges")
    genes = spark.read.parquet(genes).select(F.col("gene_idx").alias("idx"), "gene_id").distinct()
    g = graph.Graph(ws.save(graph.vertices_of(e, genes), "vertices"), e, symmetric=True)
    sources = a.bfs_source or traverse.source_vertices(g.vertices, a.bfs_sources)
    seeds = [r.idx for r in g.vertices.where(F.col("idx").isin(a.rwr_seeds)).collect()]
    made = {
        "bfs": lambda: traverse.bfs_wide(traverse.bfs(g, sources), sources),
        "pagerank": lambda: rank.pagerank(g).withColumnRenamed("x", "pagerank"),
        "rwr": lambda: rank.rwr(g, seeds).withColumnRenamed("x", "rwr_relevance"),
        "hits": lambda: rank.hits(g).select("idx", F.col("hub").alias("hub_score"), F.col("authority").alias("authority_score")),
        "louvain": lambda: community.best_louvain(g, a.restarts),
        "mcl": lambda: mcl.mcl_clusters(mcl.mcl(g), g.vertices),
        "motif": lambda: motif.motifs(g),
        "gnn": lambda: gcn.wide(gcn.gcn(g, hidden=a.hidden_dim, out=a.out_dim), a.out_dim),
    }
    if expression:
        x = spark.read.parquet(expression)
        made["mce"] = lambda: entropy.mce(x, x.select("gene").distinct().orderBy("gene").limit(a.mce_regulators)).withColumnRenamed("gene", "idx")
    took = []
    for name in chosen(a.algo):
        if name not in made:
            print(f"{name}: left out, it needs --expr", file=sys.stderr)
            continue
        df, secs = report.timed(made[name], f"{a.outdir}/{name}")
        took.append((name, secs))
        at = f"{a.outdir}/{name}_csv"
        if name == "bfs":
            df = df.withColumnRenamed(f"dist_from_{sources[0]}", "bfs_distance") if len(sources) == 1 else df
            sinks.save_sorted(df, genes, at, "idx")
        elif name in ("pagerank", "rwr", "mce"):
            sinks.save_scores(df, genes, at, df.columns[1], ascending=name == "mce")
        elif name == "hits":
            for c in ("hub_score", "authority_score"):
                sinks.save_scores(df.select("idx", c), genes, f"{a.outdir}/hits_{c}_csv", c)
        elif name in ("louvain", "mcl"):
            sinks.save_partition(df, genes, at)
        else:
            sinks.save_sorted(df, genes, at, *([F.desc("triangles"), "idx"] if name == "motif" else ["idx"]))
    t = spark.createDataFrame(took, "algorithm string, seconds double").orderBy("algorithm")
    t.coalesce(1).write.mode("overwrite").csv(f"{a.outdir}/timing", header=True)
    single, parallel = (report.read_seconds(spark, p) if p else None for p in (a.single_timing, a.parallel_timing))
    if single is None:
        out = report.own_report(t)
    elif parallel is None:
        out = report.speedup_report(single, t, a.workers or spark.sparkContext.defaultParallelism)
        report.report_totals(out).coalesce(1).write.mode("overwrite").csv(f"{a.outdir}/totals", header=True)
    else:
        out = report.three_way_report(t, single, parallel)
    out = out.orderBy("algorithm")
    out.coalesce(1).write.mode("overwrite").csv(f"{a.outdir}/comparison", header=True)
    report.printed(out).coalesce(1).write.mode("overwrite").csv(f"{a.outdir}/report", header=True)
    return report.printed(out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netspark")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("graph")
    b.add_argument("--input", required=True)
    b.add_argument("--outdir", default="output")
    b.add_argument("--max-genes", type=int, default=10_000)
    b.add_argument("--cpm-threshold", type=float, default=1.0)
    b.add_argument("--min-samples-frac", type=float, default=0.2)
    b.add_argument("--corr-threshold", type=float, default=0.7)
    b.add_argument("--resume", action="store_true")
    r = sub.add_parser("run")
    r.add_argument("--graph", help="the outdir of graph; or give --edges and --genes")
    r.add_argument("--edges")
    r.add_argument("--genes")
    r.add_argument("--expr")
    r.add_argument("--outdir", default="output")
    r.add_argument("--algo", default="all", choices=["all", *GROUPS, *ALGOS])
    r.add_argument("--bfs-source", type=int, nargs="*")
    r.add_argument("--bfs-sources", type=int, default=10)
    r.add_argument("--rwr-seeds", type=int, nargs="*", default=[0, 1, 2, 3, 4])
    r.add_argument("--mce-regulators", type=int, default=50)
    r.add_argument("--hidden-dim", type=int, default=64)
    r.add_argument("--out-dim", type=int, default=32)
    r.add_argument("--restarts", type=int, default=8)
    r.add_argument("--single-timing", help="CSV of algorithm and seconds: a report against it")
    r.add_argument("--parallel-timing", help="a second one: a three-way report")
    r.add_argument("--workers", type=int)
    sub.add_parser("doctor")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or get_session("netspark")
    {"graph": build_graph, "run": run_algos, "doctor": lambda s, _: doctor(s)}[a.command](spark, a).show(50, truncate=False)
    clean(spark)


if __name__ == "__main__":
    main()
